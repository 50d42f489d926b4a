import json
import random
import re

from pyspark.sql import functions as F

from logloom.functions import json_text as js, text as tx


def column(spark, values, make, schema="x string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def chunks(text, size=800, step=700):
    return [text[i : i + size] for i in range(0, len(text or ""), step)]


def test_chunks_at_the_edges_and_on_random_text(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aé漢🙂 \n") for _ in range(n)) for n in (0, 1, 700, 701, 800, 801, 1400, 1500, 5000)]
    assert column(spark, [*texts, None], tx.chunks_of) == [chunks(t) for t in [*texts, None]]


def test_failed_testcases_agrees_with_python(spark):
    rng = random.Random(3)
    words = ["TESTCASE:", "FAILED", "PASSED", "a", "b_1", " ", "  ", "\n", "\r", " ", "é"]
    texts = ["".join(rng.choice(words) for _ in range(30)) for _ in range(200)]
    texts += ["TESTCASE:\n a\nFAILED", "TESTCASE: b PASSED TESTCASE: c FAILED", ""]
    expected = [re.findall(r"TESTCASE:\s*(.*?)\s*FAILED", t) for t in texts]
    assert column(spark, texts, tx.failed_testcases) == expected


def test_decoding_leaves_out_bad_bytes(spark):
    raw = [b"a\xffb", "é漢".encode(), b"", b"\xc3"]
    assert column(spark, raw, tx.decode_utf8, "x binary") == [b.decode("utf-8", errors="ignore") for b in raw]


def test_blank_guard(spark):
    texts = ["", " \t\n", "  ", "x", " x ", None]
    assert column(spark, texts, tx.is_blank) == [True, True, True, False, False, True]


def test_ids_and_prefixes(spark):
    assert column(spark, ["test_login"], tx.ticket_id) == ["TEST-8116"]
    assert column(spark, ["🙂é漢x"], lambda c: tx.prefix(c, 3)) == ["🙂é漢"]
    first, again = column(spark, ["a", "a"], lambda c: tx.record_id(F.lit("k"), c))
    assert first == again and len(first) == 64


def test_joins_and_defaults(spark):
    rows = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "x array<string>")
    out = rows.select(tx.joined_or(F.col("x"), "None identified").alias("j"), tx.none_if_empty(F.col("x")).alias("n"))
    assert [tuple(r) for r in out.collect()] == [("a\nb", ["a", "b"]), ("None identified", None), ("None identified", None)]
    picked = spark.sql("SELECT NULL AS d, 'e' AS e UNION ALL SELECT 'd', 'e' UNION ALL SELECT NULL, NULL")
    assert [r[0] for r in picked.select(tx.ticket_details(F.col("d"), F.col("e"))).collect()] == ["e", "d", ""]
    reports = spark.sql("SELECT '' AS f, 's' AS s UNION ALL SELECT 'f', 's' UNION ALL SELECT NULL, ''")
    assert [r[0] for r in reports.select(tx.chosen_report(F.col("f"), F.col("s"))).collect()] == ["s", "f", None]


def loads(text):
    try:
        return True, json.loads(text)
    except json.JSONDecodeError:
        return False, None


PROBES = [
    '{"a":1}', '{"a":1} trailing', '{"a":1}}', "[1,2]", "1,2", "1],[2", '1,"x":2', "1", '"s"', "null", "true", "", " ",
    "{x}", '{"a":1,"a":2}', " [1] ", "[1] [2]", '{"a":', '"a" : 1', "'a'", "[1,]", "01", '{"k": [1, {"z": "]"}]}', "1 2",
]


def test_strict_json_accepts_what_python_accepts(spark):
    rng = random.Random(11)
    pieces = ['{"a":1}', "[1]", ",", "]", "[", "}", '"', "1", " ", "\n", ":"]
    texts = PROBES + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    got = column(spark, texts, lambda c: F.to_json(js.strict_json(c)))
    for text, value in zip(texts, got):
        valid, parsed = loads(text)
        assert (value is not None) == valid, text
        if valid:
            assert json.loads(value) == parsed


def find(text):
    for candidate in (text, _group(r"```json\s*(.*?)\s*```", text), _group(r"(\{.*\})", text)):
        if candidate is not None and loads(candidate)[0]:
            return loads(candidate)[1]
    return None


def _group(pattern, text):
    found = re.search(pattern, text, re.DOTALL)
    return found.group(1) if found else None


def test_find_json_tiers(spark):
    texts = [
        '{"a": 1}', 'x ```json\n{"a": 1}\n``` y', 'so {"a": {"b": 2}} it is', "nothing",
        'list [{"a":1},{"a":2}] end', 'list [{"a":1}] end', '```json\nbad\n``` {"c": 3}', '```json [1,2] ``` {"c": 3}',
    ]
    got = column(spark, texts, lambda c: F.to_json(js.find_json(c)))
    assert [None if g is None else json.loads(g) for g in got] == [find(t) for t in texts]


def test_list_check_raw_and_reply(spark):
    texts = ["[1]", "[]", '{"a":1}', "null", "[null]"]
    assert column(spark, texts, lambda c: js.is_filled_list(js.strict_json(c))) == [True, False, False, False, True]
    raw = column(spark, ["plain", '{"a":1}'], lambda c: F.to_json(js.json_or_raw(c)))
    assert [json.loads(r) for r in raw] == [{"raw": "plain"}, {"a": 1}]
    replies = [
        '{"overall_status": "ALL_PASSED"}', '{"overall_status": "SOME_FAILED", "failed_tests": ["t"]}',
        '```json\n{"overall_status": "ALL_PASSED"}\n```', "oops", '{"failed_tests": []}',
    ]
    assert column(spark, replies, js.reply_status) == ["passed", "failed", "failed", "failed", "failed"]
    assert column(spark, replies, js.reply_failed_tests) == [None, ["t"], None, None, None]


def test_lines_end_in_one_kind_before_the_split(spark):
    texts = ["a\r\r\nb\n\rc\r\n", "", "\r", "one", None, "x\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.lines_of(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["a", "", "b", "", "c", ""], [""], ["", ""], ["one"], None, ["x", "", ""]]
    assert "|" not in str(tx.lines_of(F.col("t")))  # alternatives are tried at every character
