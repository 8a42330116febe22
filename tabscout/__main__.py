"""python -m tabscout."""

import sys

from tabscout.cli import main

sys.exit(main())
