import datetime as dt

from pyspark.sql import functions as F

from logloom import schemas
from logloom.session import cut_lineage
from logloom.operators import augment as ag, enrich as en, review as rv, stage_log as sl, templates as tp
from logloom.operators.embed import hashing_embedder
from logloom.plans import knowledge, retrieval
from logloom.sources import tables

LOG = [
    'user "bob" logged in from 10.0.0.1:80 at 2024-06-01 10:00:00',
    'user "eve" logged in from 10.9.8.7 at 2024-06-01T10:00:05.123Z',
    "wrote /var/log/app.log in 12.5 ms, code 0xFF",
    "job 3f2b8c1e-9d4a-4e6b-8a57-0c1d2e3f4a5b done",
    "wrote /tmp/x/y in 7 ms, code 0xAB",
    "   ",
]


def lines(spark, texts=LOG, run="r1"):
    return spark.createDataFrame([(run, i, t) for i, t in enumerate(texts)], "run_id string, line_no long, line string")


def test_masks_and_variables(spark):
    got = tp.with_variables(lines(spark)).orderBy("line_no").collect()
    assert got[0].template == "user <STR> logged in from <IP> at <TS>" == got[1].template
    assert got[2].template == "wrote <PATH> in <NUM> ms, code <HEX>" == got[4].template
    assert got[3].template == "job <UUID> done"
    assert {v.variable: v.value for v in got[2].variables} == {"PATH_1": "/var/log/app.log", "NUM_1": "12.5", "HEX_1": "0xFF"}
    plain = lines(spark).select(tp.mask(F.col("line")).alias("t"), "line_no").orderBy("line_no").collect()
    assert [r.t for r in plain] == [r.template for r in got]


def test_extraction_counts_values_and_context(spark):
    df = lines(spark).unionByName(lines(spark, LOG[:2] * 3, "r0"))
    found = tp.with_context(tp.extract_templates(df), df, before=1, after=2).collect()
    by = {r.template: r for r in found}
    assert len(by) == 3
    login = by["user <STR> logged in from <IP> at <TS>"]
    assert (login.n_lines, login.n_runs, login.first_run, login.first_line) == (8, 2, "r0", 0)
    assert login.context.before == [] and login.context.match == LOG[0] and login.context.after == [LOG[1], LOG[0]]
    assert login["values"] == [{"STR_1": '"bob"', "IP_1": "10.0.0.1:80", "TS_1": "2024-06-01 10:00:00"}]
    values = {(r.variable, r.value): r.n for r in tp.template_values(df).collect()}
    assert values["STR_1", '"bob"'] == 4 and values["NUM_1", "7"] == 1


def test_guidance_masks_run_first(spark):
    got = tp.extract_templates(lines(spark), guidance=[("USER", r"user \"\w+\"")]).collect()
    assert "<USER> logged in from <IP> at <TS>" in {r.template for r in got}


def test_wildcard_merge_does_not_depend_on_order(spark):
    df = lines(spark, [f"start worker{c} now" for c in "abcde"] + ["stop all now", "stop none now"])
    merged = {r.template: r.n_lines for r in tp.merge_wildcards(tp.extract_templates(df), 3).collect()}
    assert merged == {"start <*> now": 5, "stop all now": 1, "stop none now": 1}


SME = [("USER <name>  logged in from <addr> at <when>", "WARN", "Auth", "login", "none needed"), ("never seen", "INFO", "System", "s", "r")]


def enriched(spark):
    df = lines(spark)
    found = tp.with_context(tp.extract_templates(df), df)
    return en.enrich(found.select("template", "values", "context"), spark.createDataFrame(SME, schemas.SME))


def test_enrichment_is_a_full_outer_join(spark):
    by = {r.template: r for r in enriched(spark).collect()}
    assert len(by) == 4
    login = by["user <STR> logged in from <IP> at <TS>"]
    assert (login.severity, login.causality, login.summary, login.source, login.resolution) == ("WARN", "Auth", "login", "SME", "none needed")
    new = by["never seen"]
    assert new["values"] == [] and new.context is None and new.source == "SME"
    assert by["job <UUID> done"].source == "AI Suggested" and by["job <UUID> done"].severity in en.SEVERITIES


def test_labels(spark):
    texts = ["FATAL: disk full", "login failed", "connection timeout", "retry of sql query", "hello"]
    s, c, _ = en.labels(F.col("t"))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(s, c).collect()
    assert [tuple(r) for r in got] == [
        ("CRITICAL", "System"), ("ERROR", "Auth"), ("ERROR", "Network"), ("WARN", "Database"), ("INFO", "Application"),
    ]


def test_review(spark):
    templates = spark.createDataFrame(
        [(f"t{i}", f"text {i}", "INFO", "System", "s", "AI Suggested") for i in range(5)],
        "template_id string, template string, severity string, causality string, summary string, source string",
    )
    day = lambda n: dt.datetime(2024, 1, n)
    decisions = spark.createDataFrame(
        [
            ("t0", "approve", None, None, day(1)), ("t1", "approve", None, None, day(1)), ("t1", "reject", None, None, day(2)),
            ("t2", "edit", "Category", "Auth", day(1)), ("t2", "edit", "SEVERITY", "WARN", day(1)), ("t2", "edit", "severity", "ERROR", day(3)),
            ("t3", "edit", "template", "hacked", day(1)), ("t3", "shrug", None, None, day(1)),
        ],
        "template_id string, action string, field string, value string, decided_at timestamp_ntz",
    )
    got = {r.template_id: r for r in rv.apply_review(templates, decisions).collect()}
    assert set(got) == {"t0", "t2", "t3", "t4"}
    assert (got["t2"].severity, got["t2"].causality, got["t2"].review_action) == ("ERROR", "Auth", "edit")
    assert got["t3"].template == "text 3" and got["t3"].review_action == "pending"
    assert rv.apply_review(templates, decisions, on_reject="keep").count() == 5
    assert rv.split_decisions(decisions)[1].count() == 2
    light = rv.apply_review(templates, decisions).select("template_id", rv.traffic_light(F.col("source"), F.col("review_action")).alias("l"))
    assert {r.template_id: r.l for r in light.collect()} == {"t0": "amber", "t2": "amber", "t3": "red", "t4": "red"}
    sme = spark.createDataFrame([("TEXT  0", "INFO", "System", "s", "r")], schemas.SME)
    assert [r.template for r in rv.promotable(rv.apply_review(templates, decisions), sme).collect()] == ["text 2"]


def test_variants_are_repeatable_and_keep_the_originals(spark):
    base = enriched(spark).drop("resolution")
    both = ag.augment(base)
    first, again = ({tuple(map(str, r)) for r in both.collect()} for _ in range(2))
    assert first == again
    per = {r.template: r.n for r in both.where("variant_no > 0").groupBy("template").agg(F.count("*").alias("n")).collect()}
    assert len(per) == 4 and all(3 <= n <= 5 for n in per.values())
    row = both.where("variant_no = 1 AND template LIKE 'wrote%'").first()
    assert row.source == "AI Augmented" and set(row["values"][0]) == {"PATH_1", "NUM_1", "HEX_1"}
    assert "<" not in row.context.match and row["values"][0]["PATH_1"] in row.context.match
    assert ag.augment(base.where("false")).count() == 0


def test_stage_log_with_and_without_rows(spark):
    some, none = spark.range(3), spark.range(0)
    got = sl.knowledge_log("s", [some, some, none, none]).orderBy("seq").collect()
    assert [r.n_rows for r in got] == [3, 3, 0, 0]
    assert got[0].message == "Extracted 3 unique templates." and got[3].message == "No templates available for vectorization."


def test_reply_lists(spark):
    rows = spark.createDataFrame([("[{}]",), ("[]",), ('{"a":1}',), ('see [{"a":1}] ok',)], "reply string")
    assert [r.reply for r in en.valid_templates(rows, "reply").collect()] == ["[{}]"]


def test_build_store_and_retrieve(spark, tmp_path):
    sme, empty = spark.createDataFrame(SME, schemas.SME), spark.createDataFrame(
        [], "template_id string, action string, field string, value string, decided_at timestamp_ntz"
    )
    path = str(tmp_path / "vectors")
    assert tables.open_collection(spark, path).count() == 0
    pending = knowledge.pending_templates(lines(spark), sme)
    records = knowledge.index_reviewed(pending, empty, hashing_embedder(32), 32)
    tables.append_vectors(records, path)
    stored = tables.open_collection(spark, path)
    n = stored.count()
    assert n == records.count() > 4
    tables.append_vectors(records, path)  # a second run adds nothing
    assert tables.open_collection(spark, path).count() == n
    assert tables.open_collection(spark, path, "other").count() == 0
    queries = spark.createDataFrame([("q", "user logged in from somewhere")], "query_id string, query string")
    hits = retrieval.retrieve(queries, stored, hashing_embedder(32), 32, top_k=3).orderBy("rank").collect()
    assert len(hits) == 3 and hits[0].document.startswith("user <STR> logged in")
    assert hits[0].metadata.severity == "WARN" and hits[0].distance <= hits[1].distance


def test_review_message(spark):
    rows = spark.createDataFrame([(True,), (False,), (None,)], "ok boolean")
    got = [r[0] for r in rows.select(rv.review_message(F.col("ok"))).collect()]
    assert got == [rv.APPROVED, rv.NOT_APPROVED, rv.NOT_APPROVED]


def test_an_edit_does_not_undo_a_rejection(spark):
    templates = spark.createDataFrame(
        [(f"t{i}", "x", "INFO", "System", "s", "AI Suggested") for i in range(3)],
        "template_id string, template string, severity string, causality string, summary string, source string",
    )
    decisions = spark.createDataFrame(
        [
            ("t0", "reject", None, None, "2024-01-02"), ("t0", "edit", "severity", "WARN", "2024-01-03"),
            ("t1", "approve", None, None, "2024-01-02"), ("t1", "reject", None, None, "2024-01-02"),
            ("t2", "reject", None, None, "2024-01-01"), ("t2", "approve", None, None, "2024-01-02"),
        ],
        "template_id string, action string, field string, value string, decided_at string",
    )
    got = {r.template_id: r.review_action for r in rv.apply_review(templates, decisions, "keep").collect()}
    assert got == {"t0": "reject", "t1": "reject", "t2": "approve"}
    assert [r.template_id for r in rv.apply_review(templates, decisions).collect()] == ["t2"]


def test_all_expert_rows_of_a_key_stay(spark):
    sme = spark.createDataFrame(
        [("x <N>", "WARN", "Auth", "one", None), ("x <M>", "WARN", "Auth", "two", None), ("x <M>", "WARN", "Auth", "two", None)], schemas.SME
    )
    templates = spark.createDataFrame([("x <NUM>",)], "template string").select(
        "template", F.array().cast("array<map<string,string>>").alias("values"), F.lit(None).cast(tp.CONTEXT_TYPE).alias("context")
    )
    assert sorted(r.summary for r in en.enrich(templates, sme).collect()) == ["one", "two"]
    assert sorted(r.template for r in en.enrich(templates.limit(0), sme).collect()) == ["x <M>", "x <N>"]


def test_position_partitioning(spark):
    """Groups of one shape become templates, unlike lines stay, masses of unlike lines of one shape are free text."""
    words = [f"w{i}" for i in range(60)]
    alike = [f"disk {w} of node n{i % 3} is full" for i, w in enumerate(words)]
    moved = [f"task {w} moved to node n{i % 30} now" for i, w in enumerate(words)]
    prose = [f"{a} {b} {c}" for a, b, c in zip(words, words[7:] + words[:7], words[13:] + words[:13])]
    few = ["one of a kind", "none like this one here at all"]
    df = lines(spark, [*alike, *moved, *prose, *few, few[0]])
    templates = tp.extract_templates(df.repartition(5))
    merged = tp.merge_similar(templates, tp.similar_templates(templates)).collect()
    assert {(r.template, r.kind, r.n_lines, r.n_templates) for r in merged} == {
        ("disk <*> of node <*> is full", "similar", 60, 60), ("task <*> moved to node <*> now", "similar", 60, 60),
        ("<*>", "free text", 60, 60), (few[0], "single", 2, 1), (few[1], "single", 1, 1),
    }
    strict = tp.similar_templates(templates, similarity=0.9, free_text=1000)
    assert {r.kind for r in strict.collect()} == {"single"}
    first = {r.template: (r.first_run, r.first_line) for r in merged}
    assert first["<*>"] == ("r1", 120) and first[few[0]] == ("r1", 180)
    assert tp.similar_templates(templates.limit(0)).count() == 0


def test_job_a_merges_templates_of_like_structure(spark):
    df = lines(spark, [f"start worker{c} on host now" for c in "abcdefgh"] + LOG)
    pending = {r.template: r for r in knowledge.pending_templates(df, spark.createDataFrame([], schemas.SME)).collect()}
    merged = pending["start <*> on host now"]
    assert merged.context.match == "start workera on host now" and merged.context.after == ["start workerb on host now", "start workerc on host now"]
    assert "user <STR> logged in from <IP> at <TS>" in pending and len(pending) == 4


def test_partitioning_stores_the_templates_once(spark, monkeypatch):
    """Rounds store decisions, not the templates or their tokens again; many decisions give the same parts as few."""
    rows = [(f"a{i % 3} b{i % 7} c{i} d{i} e{i} f{i} g{i % 2}",) for i in range(300)] + [(f"x y {i} z w v",) for i in range(40)]
    templates = spark.createDataFrame(rows, "template string")
    stored = []

    def recorded(df):
        found = cut_lineage(df)
        stored.append((found.columns, found.count()))
        return found

    monkeypatch.setattr(tp, "cut_lineage", recorded)
    members = {r.template: r.part for r in tp.partition_members(templates).collect()}
    assert len(members) == len(rows) and len(set(members.values())) > 10
    assert [n for columns, n in stored if "template" in columns] == [len(rows)]
    assert all("tokens" not in columns for columns, _ in stored) and max(n for _, n in stored) == len(rows)
    monkeypatch.setattr(tp, "SPLITS", 0)
    assert {r.template: r.part for r in tp.partition_members(templates).collect()} == members


def test_lines_without_anything_to_mask_are_looked_at_once(spark):
    lines = ["plain words", "abcdefab-abcd-abcd-abcd-abcdefabcdef", "at 10.0.0.1:80", 'say "x y"', "in /var/log/x", "0xFF", "2024-01-02 03:04:05", "", None, "1_2"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    unguarded = F.col("line")
    for kind, pattern in tp.MASKS:
        unguarded = F.regexp_replace(unguarded, pattern, f"<{kind}>")
    own = [("WORD", "plain")]
    found = rows.select(tp.mask(F.col("line")), unguarded, tp.mask(F.col("line"), [*own, *tp.MASKS]), tp.mask(F.col("line"), own)).collect()
    assert all(r[0] == r[1] for r in found)
    assert [found[0][2], found[0][3], found[2][3]] == ["<WORD> words", "<WORD> words", "at 10.0.0.1:80"]
    assert "CASE WHEN" in str(tp.mask(F.col("line")))
