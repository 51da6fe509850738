import json

from pyspark.sql import functions as F

from factloom.operators import agreement as A
from factloom.operators import outcomes as O
from factloom.operators import reconcile as R
from factloom.plans import phases
from factloom.sources import external, readers, sinks, tei
from factloom.streaming import watch

STATS = "key string, pos int, outcome_name string, outcome_description string, table_number string, treatment_arm string, subgroup string, effect_size double, p_value double, standard_error double, confidence_interval string, sample_size long, literal_text string, text_position string"


def stats(spark):
    return spark.createDataFrame([
        ("K", 0, "Income", "first", "2", "A", "", 1.0, 0.5, 0.1, None, 10, "x", "p1"),
        ("K", 1, "Income", "second", "1", "B", None, None, None, None, None, None, "", None),
        ("K", 2, None, None, "1", None, None, 2000.0, 2.0, 1.0, None, 5, "y", "p2"),
    ], STATS)


def test_group_flatten_round_trip(spark):
    groups = phases.grouped(stats(spark))
    by = {r["outcome_name"]: r for r in groups.collect()}
    assert by["Income"]["outcome_description"] == "first" and by["Income"]["tables"] == ["1", "2"] and by["Income"]["subgroups"] == [] and "Unknown" in by
    flat = O.flatten_groups(groups.withColumn("study_id", F.lit("S")))
    assert flat.count() == 3 and flat.where("effect_size = 2000").first()["outcome_name"] == "Unknown"
    assert O.mapping_summary(groups).first().asDict() == {"total_statistics": 3, "unique_outcomes": 2, "multi_arm": 1, "n_tables": 2}


def test_validation_and_quality(spark):
    v = O.validation(stats(spark), phases.checks(), ["effect_size", "se", "literal"]).first()
    assert (v["total"], v["complete"], v["missing_effect_size"], v["missing_literal"]) == (3, 2, 1, 1)
    codes = [r[0] for r in stats(spark).orderBy("pos").select(O.issue_codes(phases.checks())).collect()]
    assert codes[0] == [] and codes[1] == ["missing_effect_size", "missing_se", "missing_p_value", "missing_literal", "missing_position"]
    q = O.quality(stats(spark), {"no_effect": F.col("effect_size").isNull()}, {"effect": F.abs("effect_size") > 1000, "p": F.col("p_value") > 1}).first()
    assert q["issues"] == 3 and q["quality_score"] == 0.0
    empty = O.validation(stats(spark).limit(0), phases.checks(), ["se"]).first()
    assert empty["completeness_rate"] == 0.0


def test_explode_inner_and_outer(spark):
    p = spark.createDataFrame([("a", [("x",)]), ("b", [])], "key string, outcomes array<struct<o:string>>")
    assert O.explode_outcomes(p, ["key"]).count() == 1 and O.explode_outcomes(p, ["key"], outer=True).count() == 2


def test_status_and_totals(spark):
    h = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    m = spark.createDataFrame([("a",), ("c",), ("c",)], "k string")
    got = {r["k"]: r["status"] for r in A.study_status(h, m, "k").collect()}
    assert got == {"a": "llm_under_extracted", "b": "llm_missing", "c": "llm_over_extracted"}
    assert A.worst_first(A.study_status(h, m, "k"), "k").first()["k"] == "b"
    assert A.study_status(h, m, "k", F.col("k") != "a").where("k = 'a'").first()["status"] == "no_key_mapping"
    assert A.recall_totals(A.study_status(h, m, "k")).first()["micro_recall"] == 3 / 4


def test_agreement_wide_and_first_human_row(spark):
    llm = spark.createDataFrame([("1", "Ghana", 10.0), ("9", "Mali", 1.0)], "study_id string, country string, n double")
    human = spark.createDataFrame([("1", "Togo", 10.0, 2), ("1", "Ghana", 10.05, 1)], "study_id string, h_country string, h_n double, row int")
    pairs, lost = A.match_records(llm, human, "study_id", [F.col("row")])
    long = A.compare_records(pairs, "study_id", {"country": ("categorical", "country", "h_country"), "n": ("numeric", "n", "h_n")})
    assert lost.first()["study_id"] == "9" and A.overall(A.agreement(long)).first()["rate"] == 1.0
    assert A.wide(long, "study_id").first()["country_match"] is True


def test_reconcile(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["1", "2", None], ["2", "3"]))
    assert R.missing(a, b, ["k"]).count() == 2 and R.known(a, b, ["k"]).count() == 1  # anti and semi make up the input
    assert {r["k"]: r["side"] for r in R.coverage(a.dropna(), b, ["k"]).collect()} == {"1": "a_only", "2": "both", "3": "b_only"}
    n = spark.createDataFrame([("p", 1), ("p", 2), ("p", 5)], "key string, n int")
    assert [r["missing"] for r in R.gaps(n, "key", "n").collect()] == [[3, 4]]
    ids = spark.createDataFrame([("10",), ("A1",), ("2",)], "s string")
    assert [r[0] for r in ids.orderBy(*R.natural_order(F.col("s"))).collect()] == ["A1", "2", "10"]
    d = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new")], "k string, i int, v string")
    assert R.dedup(d, ["k"], [F.col("i")]).first()["v"] == "old" and R.latest(d, "k", [F.col("i")]).first()["v"] == "new"
    texts = spark.createDataFrame([("t", "has 121 in it", None)], "tid string, extra string, url string")
    ids = spark.createDataFrame([("121",), ("999",)], "id string").withColumn("p", F.col("id"))
    assert {(r["id"], r["match_type"]) for r in R.contains_join(texts, "tid", ["extra", "url"], ids, "id", "p").collect()} == {("121", "extra"), ("999", "NOT FOUND")}
    base, dim = spark.createDataFrame([("k", "old")], "k string, v string"), spark.createDataFrame([("k", None)], "k string, v string")
    assert R.override(base, dim, "k", ["v"]).first()["v"] is None  # a null of the dimension counts


def test_repair(spark):
    df = spark.createDataFrame([("9,079*** (1,864)", "N/A", None, None), ("5 (1)", "7", None, None), ("none", None, None, None)], "literal_text string, effect_size string, standard_error string, n_observations long")
    rows = O.repair(df).collect()
    assert rows[0]["effect_size"] == 9079.0 and rows[0]["_parsed_effect"] and rows[1]["effect_size"] == 7.0 and not rows[1]["_parsed_effect"] and not rows[2]["_eligible"]


TEI = """<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A study</title></titleStmt><sourceDesc><biblStruct><analytic>
<author><persName><forename>Ana</forename><surname>Diaz</surname></persName></author></analytic><monogr><imprint><date type="published" when="2019-05-01"/></imprint></monogr></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>Short.</p></abstract></profileDesc></teiHeader><text><body><div><head>Intro</head><p>Before <ref>ref</ref> after.</p></div></body></text></TEI>"""


def test_tei(spark):
    df = tei.document(spark.createDataFrame([("K", TEI), ("B", "not xml")], "key string, text string")).orderBy("key").collect()
    assert df[0]["_error"] == "not XML" and df[0]["title"] is None
    r = df[1]
    assert (r["title"], r["abstract"], r["year"], r["authors"][0]["full"]) == ("A study", "Short.", "2019", "Ana Diaz") and "after." in r["body"]
    compat = spark.createDataFrame([(TEI,)], "text string").select(tei.body_text(F.col("text"), compat=True)).first()[0]
    assert compat == "Intro\n\nBefore"


def test_phases_resume_and_never_ask_twice(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def client(prompt):
        calls.add(1)
        if prompt == "bad":
            raise RuntimeError("no")
        return '```json\n{"tables_found": [{"table_number": "1", "title": "T", "confidence": 0.4}, {"table_number": "4", "title": "U", "confidence": 0.9}]}\n```'

    prompts = spark.createDataFrame([("K", "ok"), ("L", "bad")], "key string, prompt string")
    path = str(tmp_path / "phase1")
    first = phases.ask(spark, path, prompts, client, phases.TABLES)
    tables = phases.discovered(first)
    assert tables.count() == 2 and first.where("key = 'L'").first()["error"].startswith("RuntimeError")
    asked = calls.value
    assert phases.ask(spark, path, prompts, client, phases.TABLES).count() == 2 and calls.value == asked
    warnings = phases.discovery_warnings(tables).first()["warnings"]
    assert warnings == ["1 low-confidence tables", "missing table numbers: 2, 3"]
    classes = spark.createDataFrame([("K", "1", "RESULTS", None), ("K", "4", "RESULTS", 0.2), ("K", "9", "DESCRIPTIVE", 0.9)], "key string, table_number string, classification string, confidence double")
    results, other = phases.split_classes(classes, tables)
    assert [r["title"] for r in results.collect()] == ["T"] and other.count() == 1
    assert phases.wanted_fallback(results, results.limit(0)).count() == 1 and phases.wanted_fallback(results, results, "never").count() == 0


def test_merge_sources_names(spark):
    t = spark.createDataFrame([("1", 5)], "table_number string, sample_size long")
    p = spark.createDataFrame([("2", 7, 0.1, 0.2)], "_table_number string, n_observations long, ci_lower double, ci_upper double")
    rows = O.merge_sources(t, p).orderBy("table_number").collect()
    assert rows[1]["table_number"] == "2" and rows[1]["sample_size"] == 7 and rows[1]["confidence_interval"] == "[0.1, 0.2]" and rows[1]["_supplemented"]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "K1.tei.json").write_text(json.dumps({"outcomes": [{"v": 1}, {"v": 2}]}))
    got = readers.outcome_documents(spark, str(tmp_path / "in"), "study_id string, outcomes array<struct<v:int>>").collect()
    assert [(r["outcome_number"], r["v"]) for r in got] == [(1, 1), (2, 2)]
    (tmp_path / "form.csv").write_text("x,\ny,\nid,name\n1,\"a\nb\"\n2,c\n")
    rows = readers.csv_after_preamble(spark, str(tmp_path / "form.csv"), 2, {0: "id", 1: "name"}).orderBy("source_row").collect()
    assert [(r["id"], r["name"]) for r in rows] == [("1", "a\nb"), ("2", "c")]
    (tmp_path / "multi.csv").write_text("A,,B\nx,y,z\n1,2,3\n")
    assert readers.csv_multi_header(spark, str(tmp_path / "multi.csv"), 2).columns == ["A / x", "A / y", "B / z"]
    assert readers.first_existing(spark, str(tmp_path / "none"), str(tmp_path / "in")).endswith("in")
    assert readers.listing(spark, str(tmp_path / "in")).count() == 1
    sinks.id_list(spark.createDataFrame([("a",)], "k string"), "k", str(tmp_path / "ids"))
    records = O.flatten_groups(phases.grouped(stats(spark)).withColumn("study_id", F.lit("S"))).drop("pos")
    assert sinks.final_export(records, str(tmp_path / "out")) and spark.read.csv(str(tmp_path / "out/csv"), header=True).columns == O.RECORD
    assert not sinks.final_export(records.limit(0), str(tmp_path / "none_out"))
    assert "overall" in sinks.agreement_report(spark.createDataFrame([("f", 1, 1, 0, 1.0)], "field string, agreements int, comparisons int, both_null int, rate double"), spark.createDataFrame([(1.0,)], "rate double"))


def test_retry_and_pages():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError("timeout")
        return "ok"

    assert external.with_retry(flaky, sleep=lambda s: None) == "ok"
    assert len(list(external.paginated(lambda start, size: [{"i": i} for i in range(start, min(start + size, 250))]))) == 250


def test_watch_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.txt").write_text("9,079*** (1,864) N = 40")
    watch.run_available(watch.parsed_estimates(watch.watch_texts(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r["key"], r["effect_size"], r["n_observations"]) == ("A", 9079.0, 40)


def test_counts_of_empty_and_sparse_tables(spark):
    rows = spark.createDataFrame([("K", "a", None, "3"), ("K", None, " ", None), ("L", "b", "x", None)], "key string, t string, u string, source string")
    got = O.conversion(rows, rows.where("key = 'K'"), "key").first()
    assert (got["papers"], got["first_rows"], got["second_rows"]) == (2, 3, 2) and abs(got["ratio"] - 2 / 3) < 1e-12
    assert O.conversion(rows, rows.limit(0), "key").first()["ratio"] == 0
    assert {(r["category"], r["filled"], r["cells"]) for r in O.category_completeness(rows, {"both": ["t", "u"], "one": ["source"]}).collect()} == {("both", 3, 6), ("one", 1, 3)}
    assert {(r["filled"], r["pct"]) for r in O.category_completeness(rows.limit(0), {"both": ["t", "u"]}).collect()} == {(0, 0.0)}
    assert {(r["source"], r["outcomes"], r["n_tables"]) for r in O.source_counts(rows, "source", "t", "u").collect()} == {("3", 1, 1), (None, 2, 2)}
    assert O.completeness_scores(rows, ["t", "u"]).first()["high_rows"] == 1 and O.completeness_scores(rows.limit(0), ["t"]).first()["mean_share"] == 0
