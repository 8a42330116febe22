"""Lines, shapes, fields, codecs: tables of cases."""

import csv

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabscout.functions import codecs, fields, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw, lines", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\rc\n\n", ["a", "b", "c", ""]), ("\n", [""]), ("a b\x0cc\x85d", ["a b\x0cc\x85d"]), (None, [])])
def test_lines(spark, raw, lines):
    assert one(spark, raw, text.lines) == lines
    if raw is not None:
        assert fields.python_lines(raw) == lines if raw else True


@pytest.mark.parametrize("value, shape", [
    ("", "empty"), ("  ", "empty"), ("42", "integer"), (" -7 ", "integer"), ("2023", "integer"), ("1250.50", "decimal"), ("1250,50", "decimal"), ("1.234,56", "decimal"), ("-0.5", "decimal"), ("2024-01-15", "date"),
    ("2024-01-15 08:30:00", "date"), ("15/01/2024", "date"), ("15.01.2024", "date"), ("1-2-24", "date"), ("Acme S.L.", "text"), ("A-0042", "text"), ("Importe", "text"), ("٤٢", "integer"), ("1\n2", "text"), (".5", "decimal"),
])
def test_field_shape(spark, value, shape):
    assert one(spark, value, text.field_shape) == shape


@pytest.mark.parametrize("line, yes", [
    # blank
    (" \t", True),
    # a bare label, whatever follows
    ("Grand total|7|8|9", True), ("'Suma'|1|2", True), ("totales:|4|4|4", True), ("Sub - Totals|a|b|c", True),
    # a label in words, and few other fields
    ("Sum of all rows|||17", True), ("grand totals 2031||", True),
    # the same with many
    ("Sum of all rows|5|6|17", False), ("Total Recall|1990|film", False),
    # no label
    ("Summit|||", False), ("subtotalled||", False), ("end|total", False), ("3|4|5", False),
])
def test_extends_footer(spark, line, yes):
    quote = "'" if "'" in line else '"'
    df = spark.createDataFrame([(line, fields.split_fields(line.strip(), "|", quote))], "l string, f array<string>")
    assert df.select(text.extends_footer(F.col("l"), F.col("f"))).first()[0] is yes


@pytest.mark.parametrize("a, b, alike", [
    (["1", "x"], ["2", "y"], True), (["1", "x"], ["y", "2"], False), (["1", ""], ["2", "2024-01-01"], True), (["1", "2.5", ""], ["2", "3.5", "x"], True), (["x", "", "y"], ["z", "1", "w"], False), (["a"], ["b"], True),
])
def test_look_alike(spark, a, b, alike):
    assert spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(text.look_alike(F.col("a"), F.col("b"))).first()[0] is alike


@pytest.mark.parametrize("raw, d, q, quoted", [('"a",b', ",", '"', True), ('a,"b"', ",", '"', True), ('x"a",b', ",", '"', False), ("'a'|b", "|", "'", True), ('a\n"b"\n', ";", '"', True), ('"a"b,c', ",", '"', False), ('a,""', ",", '"', False)])
def test_has_quoted_field(spark, raw, d, q, quoted):
    df = spark.createDataFrame([(raw, d, q)], "t string, d string, q string")
    assert df.select(text.has_quoted_field(F.col("t"), F.col("d"), F.col("q"))).first()[0] is quoted


@pytest.mark.parametrize("widths, expected", [([3, 3, 2], (2, 3)), ([2, 3, 3, 2], (2, 2)), ([1, 1, 0], (0, 1)), ([], (0, 1)), ([None, 4], (1, 4))])
def test_modal_width(spark, widths, expected):
    assert tuple(one(spark, widths, text.modal_width, "array<int>")) == expected


@pytest.mark.parametrize("line, expected", [("", []), ('"a"b,c', ["ab", "c"]), ('"a,b', ["a,b"]), ('"x\\"y",z', ['x\\y"', "z"]), ("a, b ,", ["a", " b ", ""]), ('"a""b",', ['a"b', ""])])
def test_split_fields(spark, line, expected):
    assert fields.split_fields(line, ",", '"') == expected == next(csv.reader([line]), [])
    assert spark.createDataFrame([([line],)], "l array<string>").select(fields.split_rows("l", F.lit(","), F.lit('"'))).first()[0] == [expected]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab,;"\' \t', max_size=20), st.sampled_from([",", ";", "\t"]), st.sampled_from(['"', "'"]))
def test_split_fields_is_csv(line, d, q):
    assert fields.split_fields(line, d, q) == next(csv.reader([line], delimiter=d, quotechar=q), None) or line == ""


def test_table_function(spark):
    fields.register(spark)
    rows = spark.sql("""SELECT * FROM delimited_lines('a;b\r\n"c;d"\n', ';', '"') ORDER BY line_no""").collect()
    assert [tuple(r) for r in rows] == [(0, "a;b", ["a", "b"]), (1, '"c;d"', ["c;d"])]


@pytest.mark.parametrize("data, label", [(b"abc", "utf-8"), ("é".encode(), "utf-8"), ("é".encode()[:1], "utf-8"), (b"\xef\xbb\xbfa", "utf-8-sig"), ("a,b".encode("utf-16"), "utf-16"), ("a,b".encode("utf-16-le"), "utf-16-le"), ("a,b".encode("utf-16-be"), "utf-16-be"), (b"caf\xe9 x", "cp1252"), (b"\x81\xe9 x", "latin-1")])
def test_detect(spark, data, label):
    assert codecs.detect(data) == label == one(spark, bytearray(data), codecs.detected, "binary")


SCRIPTS = {
    "cp932": "番号;名前;住所\n1;さとうさん;東京都に住んでいます\n2;たなかさん;カメラを買いました\n", "euc_jp": "番号;名前;住所\n1;さとうさん;東京都に住んでいます\n2;たなかさん;カメラを買いました\n",
    "euc_kr": "번호;이름;주소\n1;김민수;서울에 살고 있습니다\n2;이영희;부산으로 갔습니다\n", "gb18030": "编号;姓名;地址\n1;张伟;他们在北京的学校工作\n2;李娜;上海有很多人\n", "big5": "編號;姓名;地址\n1;張偉;他們在台北的學校工作\n2;李娜;這裡有很多人\n",
    "cp1251": "номер;имя;город\n1;Иван;Москва и область\n2;Ольга;Санкт-Петербург\n", "koi8-r": "номер;имя;город\n1;Иван;Москва и область\n2;Ольга;Санкт-Петербург\n", "cp1252": "número;señor;dirección\n1;José Núñez;Málaga\n2;Zoë Müller;Köln, Straße 5\n",
}


@pytest.mark.parametrize("label", sorted(SCRIPTS))
def test_detect_scripts(label):
    data = SCRIPTS[label].encode(label)
    assert codecs.detect(data) == label
    assert codecs.detect((data * 3)[: len(data) * 2 + 1]) == label  # cut within a character
    assert codecs.read_windows(data, b"", False)[1] == SCRIPTS[label]


@pytest.mark.parametrize("text", ["ééê. " * 20 + "Oian. " * 17, "treêaire étreoi, " + "ééè çéè " * 40, "nicht üäü " * 30, "ÉÈÉÈ le " * 9, "ñóñ de " * 9])
def test_detect_repeated_words_of_accents(text):
    """Words of accented letters only, repeated over a text, are one language's letters: no Cyrillic, Korean or Chinese."""
    assert codecs.detect(text.encode("cp1252")) == "cp1252"
    assert codecs.read_windows(b"x,y\n" * 1024, text.encode("cp1252"), True)[0] == "cp1252"


def test_letter_at_the_end_of_a_tail():
    """The last byte of a source is a letter of cp1252, but where UTF-8 stands before it a cut character."""
    head = b"x,y\n" * 1024
    assert codecs.read_windows(head, b"caf\xe9", True)[::2] == ("cp1252", "café")
    assert codecs.read_windows(head, "é, café".encode()[:-1], True)[0] == "utf-8"
    assert codecs.detect(b"caf\xe9") == "utf-8"  # a head that goes on


@pytest.mark.parametrize("label", ["cp1251", "koi8-r"])
@pytest.mark.parametrize("text", ["a;b\n1;нет\n2;нет\n3;нет\n", "город\nМосква\nМосква\nМосква\n", "id;кто\n1;или как\n2;папа пока\n3;мама, семь раз отмерь\n"])
def test_detect_few_cyrillic_words(label, text):
    assert codecs.detect(text.encode(label)) == label


@pytest.mark.parametrize("data", [b"", b"abc", "aé漢🙂".encode(), "é".encode()[1:] + b"x", "🙂".encode()[1:] + b"x", b"\x80\x80\x80\x80", b"a\x80", "🙂".encode()[:2]])
def test_utf8_suffix(spark, data):
    assert one(spark, bytearray(data), codecs.utf8_suffix, "binary") == codecs.is_utf8_suffix(data)


@pytest.mark.parametrize("expected, actual, yes", [("latin-1 or cp1252 (not utf-8)", "ISO-8859-1", True), ("latin-1 or cp1252 (not utf-8)", "utf-8", False), ("utf-8", "UTF8", True), ("klingon", "KLINGON", True)])
def test_matches_label(spark, expected, actual, yes):
    df = spark.createDataFrame([(expected, actual)], "e string, a string")
    assert df.select(codecs.matches_label(F.col("e"), F.col("a"))).first()[0] is yes
