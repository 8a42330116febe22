"""PII: fixed forms, and identifiers found by bootstrapped contextual patterns, with DataFrame operations only.

1. Entities of fixed form (email, ip, card, phone, and long hexadecimal secrets) are found with their
   positions in whole texts.
2. Words with a digit or @, neighbours joined, are the candidates for identifiers. Each has lexical
   patterns: its two words to the left, and its words to the left and right, if these have a letter,
   however far away they are. Candidates that a fixed form
   covers are the seeds.
3. Distinct pairs of pattern and instance (the candidate's text) are a graph. In each round a pattern's
   confidence is the mean score of its instances, and an instance that is no seed gets
   1 - product(1 - DAMPING * confidence) from its patterns. Seeds keep score 1. Scores only rise; rounds go on
   until none moves by more than TOLERANCE.
4. Candidates under a pattern of enough confidence and support are new identifiers, kind `found`.

Patterns and instances are aggregated before they meet, and joins are between written tables, so that Spark
splits the rows of a common pattern over tasks; nothing but the round count is on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.llm.shared import written

_LOCAL = "[A-Za-z0-9._%+-]"
_S, _W = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: The forms, so written that a search is linear: a run is entered at its start only (or where the last
#: match ended), and quantifiers are possessive where that changes no match.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of digits, with single blanks or hyphens between, of 12 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
#: Kinds of the base, as listed, then those that the method adds.
KINDS = ("email", "ip", "card", "phone", "secret", "found")
BASE = 4

_CANDIDATE = rf"(?<!{_W})[^\x20\x09-\x0D0-9@]*+[0-9@]{_W}*+(?:{_S}++[^\x20\x09-\x0D0-9@]*+[0-9@]{_W}*+)*+"
#: Characters around a candidate or a context word that are not part of it.
_AROUND = r"""["'`()<>\[\]{}.,;:!?*$&%#|=]"""
#: What an instance takes of a pattern's confidence; confidence and summed score of a pattern that is believed.
DAMPING, CONFIDENCE, SUPPORT = 0.8, 0.8, 3.0
#: Change of scores at which they have settled, and rounds after which something must be wrong.
TOLERANCE, MOST_ROUNDS = 0.01, 60
#: Matches whose places are summed at once.
BLOCK = 256
#: Letters and digits of a candidate that can be an identifier, at least, and digits among them.
LEAST_LENGTH, LEAST_DIGITS = 6, 3

SPAN = "array<struct<start:int,end:int,kind:int>>"


def _matched(rows: DataFrame, text: Column, pattern: str, needed: Column, name: str) -> DataFrame:
    """`rows` with __values_name, the matches, and __gaps_name, what stands before, between and after them.

    Columns of their own, so that each regular expression runs twice a text and not once for each use.
    """
    rows = rows.withColumn(f"__values_{name}", F.when(needed, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    return rows.withColumn(f"__gaps_{name}", F.when(F.size(f"__values_{name}") > 0, F.split(text, pattern, -1)))


def _let(value: Column, body) -> Column:
    """body(value), the value being computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(lengths: Column) -> Column:
    """Running sums of an array, by blocks, as appending to one array would copy it each time."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.array_append(acc["ends"], acc["at"] + x).alias("ends"))

    none = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("ends"))

    def body(whole: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int"), F.lit(1))
        blocks = F.transform(F.when(F.size(whole) > 0, numbers), lambda k: F.aggregate(F.slice(whole, k * BLOCK + 1, F.lit(BLOCK)), none, step))

        def joined(parts: Column) -> Column:
            before = F.aggregate(F.transform(parts, lambda p: p["at"]), none, step, lambda acc: acc["ends"])
            return F.flatten(F.zip_with(parts, before, lambda p, end: F.transform(p["ends"], lambda x: x + end - p["at"])))

        return F.coalesce(_let(blocks, joined), none["ends"])

    return _let(lengths, body)


def _places(name: str) -> Column:
    """Where each match ends, in code points."""
    values, gaps = F.col(f"__values_{name}"), F.col(f"__gaps_{name}")
    return _running(F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.length(v) + F.length(g)))


def _located(name: str, keep, kind: int) -> Column:
    """array<struct<start,end,kind>> of the matches that `keep` accepts; positions are code points."""
    values, gaps = F.col(f"__values_{name}"), F.col(f"__gaps_{name}")
    span = lambda v, end: F.when(keep(v), F.struct((end - F.length(v)).alias("start"), end.alias("end"), F.lit(kind).alias("kind")))
    return F.when(gaps.isNotNull(), F.array_compact(F.zip_with(values, _places(name), span))).otherwise(F.expr(f"CAST(array() AS {SPAN})"))


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, r"[^0-9]", ""))

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _address(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).try_cast("int") <= 255, F.lit(False)))


def _digits(value: Column, least: int, most: int) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(least, most)


def entities(rows: DataFrame, text: Column) -> DataFrame:
    """`rows` with __spans: all entities of fixed form in a text, by start and kind."""
    digit, yes = F.col("__digit"), lambda v: F.lit(True)
    rows = rows.withColumn("__digit", text.rlike("[0-9]"))
    forms = (
        ("email", EMAIL, F.contains(text, F.lit("@")), yes), ("ip", IP, digit & F.contains(text, F.lit(".")), _address), ("card", CARD, digit, _luhn),
        ("phone", PHONE, F.contains(text, F.lit("+")), lambda v: _digits(v, 9, 15)), ("secret", SECRET, digit, yes),
    )
    for name, pattern, needed, _ in forms:
        rows = _matched(rows, text, pattern, needed, name)
    spans = _sorted(F.concat(*(_located(name, keep, kind) for kind, (name, _, _, keep) in enumerate(forms))))
    return rows.withColumn("__spans", spans).drop("__digit", *(f"__{x}_{f[0]}" for f in forms for x in ("values", "gaps")))


def _sorted(spans: Column) -> Column:
    bare = F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return F.transform(F.array_sort(bare), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _word(text: Column) -> Column:
    """A context word as patterns have it: lower case, 0 for digits, bare."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), f"^{_AROUND}+(?=.)|(?<=.){_AROUND}+$", "")


def _beside(gap: Column) -> Column:
    """struct<two,one,right>: the last two words and the first one of what stands between candidates; empty without."""
    blank = F.translate(gap, "\t\n\x0b\f\r", "     ")

    def words(x: Column) -> Column:
        tail, right = F.rtrim(x), F.substring_index(F.ltrim(x), " ", 1)
        one = F.substring_index(tail, " ", -1)
        before = F.rtrim(F.left(tail, F.length(tail) - F.length(one)))
        return F.struct(F.substring_index(before, " ", -1).alias("two"), one.alias("one"), right.alias("right"))

    return _let(blank, words)


def candidates(rows: DataFrame, text: Column, spans: Column) -> DataFrame:
    """`rows` with __candidates: array<struct<start,end,instance,left,both,seed>> of the identifier-like words of a text and their patterns."""
    rows = _matched(rows, text, _CANDIDATE, text.rlike("[0-9@]"), "words")
    values, gaps = F.col("__values_words"), F.col("__gaps_words")
    beside = F.transform(gaps, _beside)
    ends = F.when(gaps.isNotNull(), _places("words"))
    rows = rows.withColumns({"__beside": beside, "__ends": ends})
    sides = F.zip_with(F.slice("__beside", 1, F.size(values)), F.slice("__beside", 2, F.size(values)), lambda a, b: F.struct(a["two"].alias("two"), a["one"].alias("one"), b["right"].alias("right")))
    rows = rows.withColumn("__placed", F.when(gaps.isNotNull(), F.zip_with(F.zip_with(values, "__ends", lambda v, e: F.struct(v.alias("value"), e.alias("end"))), sides, lambda c, s: F.struct(c["value"].alias("value"), c["end"].alias("end"), s.alias("s")))))

    def whole(c: Column) -> Column:
        value, start = c["value"], c["end"] - F.length(c["value"])
        one, two, right = (_word(c["s"][k]) for k in ("one", "two", "right"))
        lead = F.length(F.regexp_extract(value, f"^{_AROUND}*", 0))
        core = F.regexp_replace(value, f"^{_AROUND}+|{_AROUND}+$", "")
        begin = start + lead
        seed = F.exists(spans, lambda s: (s["start"] < c["end"]) & (s["end"] > start))
        lexical = lambda x: x.rlike("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]")
        left = F.when((one != "") & (two != "") & lexical(F.concat(two, one)), F.concat(two, F.lit(" "), one, F.lit(" _")))
        both = F.when((one != "") & (right != "") & lexical(F.concat(one, right)), F.concat(one, F.lit(" _ "), right))
        return F.struct(begin.alias("start"), (begin + F.length(core)).alias("end"), core.alias("instance"), left.alias("left"), both.alias("both"), seed.alias("seed"))

    plain = lambda c, kept: F.length(F.regexp_replace(c["instance"], f"[^{kept}]", ""))
    rows = rows.withColumn("__whole", F.transform("__placed", whole))
    good = F.filter("__whole", lambda c: c["seed"] | ((plain(c, "A-Za-z0-9") >= LEAST_LENGTH) & (plain(c, "0-9") >= LEAST_DIGITS)))
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,instance:string,left:string,both:string,seed:boolean>>)")
    return rows.withColumn("__candidates", F.coalesce(good, none)).drop("__values_words", "__gaps_words", "__beside", "__ends", "__placed", "__whole")


def believed(occurrences: DataFrame) -> DataFrame:
    """Rows (pattern, confidence, support) of the patterns to believe, from rows (pattern, instance, seed)."""
    edges = written(occurrences.where(F.col("pattern").isNotNull()).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pairs")
    several = written(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("pattern"), "several")
    edges = written(edges.join(several, "pattern", "left_semi"), "edges")
    scores = written(edges.groupBy("instance").agg(F.max("seed").alias("known")).select("instance", "known", F.col("known").cast("double").alias("score")), "instances")
    for _ in range(MOST_ROUNDS):
        patterns = edges.join(scores, "instance").groupBy("pattern").agg(F.avg("score").alias("confidence"), F.sum("score").alias("support"))
        patterns = written(patterns, "patterns")
        trusted = patterns.where(F.col("support") >= 2)
        got = edges.join(trusted, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-DAMPING * F.col("confidence"))))).alias("got"))
        score = F.when(F.col("known"), 1.0).otherwise(F.coalesce("got", F.lit(0.0)))
        scores = written(scores.join(got, "instance", "left").select("instance", "known", score.alias("score"), F.abs(score - F.col("score")).alias("moved")), "instances")
        if (scores.agg(F.max("moved")).first()[0] or 0) <= TOLERANCE:
            return patterns.where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT))
    raise RuntimeError(f"scores did not settle in {MOST_ROUNDS} rounds")


def find(docs: DataFrame, text_column: str = "text", keep_text: bool = True, spans_column: str = "__spans") -> DataFrame:
    """`docs`, all columns, with `spans_column`: array<struct<start,end,kind>>, by start and kind (numbers of KINDS).

    Kinds 0 to 3 are the base: leftmost non-overlapping matches of each form in the whole text, those that
    fail their check dropped. Kinds 4 and 5 are what the method adds: secrets and found identifiers that no
    other span covers. Nulls: a null text has no spans; other columns are only passed on, whatever their
    names; one that is named like `spans_column` is an error. Repeated rows each get their spans; empty texts
    and tables have none. keep_text=False leaves the texts out, and out of what is written.
    """
    if spans_column in docs.columns:
        raise ValueError(f"there is a column {spans_column} already: give another spans_column")
    names = [c for c in docs.columns if keep_text or c != text_column]
    own = F.struct(*(docs[c] for c in names)) if names else F.struct(F.lit(None).alias("none"))
    rows = docs.select(own.alias("__own"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("__text"))
    rows = entities(rows, F.col("__text"))
    rows = candidates(rows, F.col("__text"), F.col("__spans")).drop("__text")
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "entities")
    spread = rows.select("__row", F.explode("__candidates").alias("c")).select("__row", "c.*")
    spread = spread.select("__row", "start", "end", "instance", "seed", F.explode(F.array_distinct(F.array("left", "both"))).alias("pattern")).where(F.col("pattern").isNotNull())
    patterns = believed(spread.select("pattern", "instance", "seed"))
    new = spread.where(~F.col("seed")).join(patterns, "pattern", "left_semi").groupBy("__row").agg(F.collect_set(F.struct("start", "end", F.lit(KINDS.index("found")).alias("kind"))).alias("__new"))
    out = rows.drop("__candidates").join(new, "__row", "left")
    spans = F.when(F.col("__new").isNull(), F.col("__spans")).otherwise(_sorted(F.concat("__spans", "__new")))
    return out.select(*(F.col("__own")[c].alias(c) for c in names), spans.alias(spans_column))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < BASE)


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs`, all columns, with every span of find() replaced by its kind in brackets, as [EMAIL].

    Overlapping spans become one mark, of the first. Null texts stay null; for empty ones and tables, repeated
    rows and other columns see find().
    """
    names, column = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), "__spans"
    while column in docs.columns:
        column += "_"
    rows = find(docs, text_column, spans_column=column)
    text = F.col(text_column)
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1)))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), more.alias("parts"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts")))

    cut = F.aggregate(column, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.withColumn(text_column, F.when(F.size(column) > 0, cut).otherwise(text)).drop(column)
