import zipfile

from weftlink.operators import validation
from weftlink.operators.blocking import BlockingParams
from weftlink.plans import entities as E
from weftlink.sources import packaging, tsv
from weftlink.streaming.match_stream import match_stream

ROWS = "entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-2\t\"Acme \"\"A\"\" Ltd\"\t12 Main St\tUS\nS1-1\tNA\t\tFrance\n"


def test_entities_round_trip(spark, tmp_path):
    path = tmp_path / "s1.tsv"
    path.write_text(ROWS)
    rows = tsv.read_entities(spark, str(path))
    assert {r.entity_id: r.business_name for r in rows.collect()} == {"S1-2": 'Acme "A" Ltd', "S1-1": "NA"}
    assert {r.business_name for r in tsv.read_entities(spark, str(path), na_values=True).collect()} == {'Acme "A" Ltd', ""}
    assert [r.entity_id for r in tsv.head(rows, 1).collect()] == ["S1-1"]
    assert tsv.read_if_there(spark, str(tmp_path / "none.tsv")).count() == 0
    tsv.write_normalised(rows, str(tmp_path / "out"), "test", 1)
    back = spark.read.parquet(str(tmp_path / "out")).where("country = 'US'")
    assert [(r.name_clean, r.addr_clean, r.name_tokens, r.source) for r in back.collect()] == [("acme a", "12 main street", "acme", 1)]
    assert "PartitionFilters: [isnotnull(country" in back._jdf.queryExecution().toString()


def test_lists(spark, tmp_path):
    lists = spark.createDataFrame([("S1-1", "S2-1,S3-2"), ("S1-2", "")], "s1_id string, matched string")
    path = str(tmp_path / "m")
    tsv.write_lists(lists, path)
    tsv.write_lists(lists, path)
    got = {r.s1_id: r.ids for r in tsv.read_id_lists(spark, path).collect()}
    assert got == {"S1-1": ["S2-1", "S3-2"], "S1-2": []}
    assert {tuple(r) for r in tsv.pairs_of(tsv.read_id_lists(spark, path)).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-2")}
    assert {r.entity_id for r in tsv.read_ids(spark, path).collect()} >= {"S1-1", "S1-2"}


def test_packaging_is_gated(spark, tmp_path):
    good = spark.createDataFrame([("x", "error", 0, ""), ("y", "warning", 3, "")], "rule string, severity string, n long, examples string")
    bad = good.withColumn("n", good.n + 1)
    (tmp_path / "m.tsv").write_text("a")
    assert packaging.package(good, {"m.tsv": str(tmp_path / "m.tsv")}, str(tmp_path / "o.zip")) and zipfile.ZipFile(tmp_path / "o.zip").namelist() == ["m.tsv"]
    assert not packaging.package(bad, {}, str(tmp_path / "p.zip")) and not (tmp_path / "p.zip").exists()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from weftlink.operators.blocking import candidate_pairs

    rows = E.records(E.entities(E.documents(spark, sf_dir)))
    a, t = E.reference(rows), E.targets(rows)
    p = BlockingParams(max_df=40, pool=20, per_source=3)
    a.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    match_stream(stream, t, str(tmp_path / "out"), str(tmp_path / "cp"), p).awaitTermination()
    got = {(r.s1_id, r.t_id, r["rank"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.s1_id, r.t_id, r["rank"]) for r in candidate_pairs(a, t, p).collect()}


def test_report_has_a_row_for_each_rule(spark):
    empty = spark.createDataFrame([], "id string, list string, line string")
    assert {r.n for r in validation.report(validation.list_findings(empty)).collect()} == {0}


def test_service(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from weftlink.sources.service import routes, serve

    rows = spark.createDataFrame([("S1-1", "US", "acme steel", "1 main street", 1), ("S1-2", "FR", "blue", "", 0)], "entity_id string, country string, name string, address string, match_count int")
    matches = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, t_id string")
    (tmp_path / "f.tsv").write_bytes(b"x" * 3_000_000)
    (tmp_path / "page.html").write_text("<p>page</p>")
    server = serve(routes(spark, rows, rows, matches), {"/download/f": str(tmp_path / "f.tsv")}, 0, str(tmp_path / "page.html"))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}").read()
    try:
        assert json.loads(get("/api/entities?search=STEEL"))["entities"][0]["entity_id"] == "S1-1"
        assert {r["country"]: r["matched"] for r in json.loads(get("/api/stats"))["countries"]} == {"ALL": 1, "US": 1, "FR": 0}
        assert len(get("/download/f")) == 3_000_000 and get("/") == b"<p>page</p>"
        head = urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/download/f").headers
        assert head["Content-Disposition"] == 'attachment; filename="f.tsv"' and head["Content-Type"] == "text/tab-separated-values"
        try:
            get("/api/none")
            raise AssertionError
        except urllib.error.HTTPError as e:
            assert e.code == 404
    finally:
        server.shutdown()


def test_validator(spark, tmp_path, capsys):
    from weftlink.sources.validator import check_results, main

    def put(name, text):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    t = str(tmp_path)
    good = "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n"
    matches, candidates = put("m.tsv", good), put("c.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-9\nS1-1\tS2-1,S3-1\nS1-2\t\n")

    def found(*args):
        return {(r.file, r.rule): (r.severity, r.n) for r in check_results(spark, *args).collect() if r.n}

    assert found(matches, None, t) == {("test", "missing_test_source"): ("error", 1)}
    put("test_source1.tsv", "entity_id\tbusiness_name\nS1-1\ta\nS1-2\tb\n")
    off = {("both", "ids_not_checked"): ("warning", 1)}
    assert found(matches, None, t) == off
    # of repeated rows the last counts for what was proposed
    assert found(matches, candidates, t) == off | {("candidates", "duplicate_row"): ("error", 1)}
    turned = put("d.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S3-1\nS1-1\tS2-9\nS1-2\t\n")
    assert found(matches, turned, t)[("both", "not_a_candidate")] == ("warning", 1)
    assert found(matches, f"{t}/none", t) == off | {("both", "no_candidate_file"): ("warning", 1)}
    assert found(matches, None, t, True) == off
    put("test_source2.tsv", "entity_id\nS2-2\n"), put("test_source3.tsv", "entity_id\nS3-1\n")
    assert found(matches, None, t, True) == {("matches", "unknown_id"): ("error", 1)}
    for name, text, rule in [("e.tsv", "", "empty_file"), ("f.tsv", "a,b\n", "not_tab_separated"), ("g.tsv", "a\tb\n", "wrong_header"), ("h.tsv", good.encode() + b"S1-3\t\xff\xfe\n", "not_utf8")]:
        assert found(put(name, text), None, t) == off | {("matches", rule): ("error", 1)}
    assert found(f"{t}/none", None, t) == off | {("matches", "missing_file"): ("error", 1)}
    assert main(["-m", matches, "-c", f"{t}/none", "-t", t], spark) == 0 and "PASS" in capsys.readouterr().out
    assert main(["-m", f"{t}/none", "-t", t], spark) == 1 and "missing_file" in capsys.readouterr().out


def test_lists_are_replaced(spark, tmp_path):
    path = str(tmp_path / "lists.tsv")
    for ids in ("S2-1", "S2-2"):
        tsv.write_lists(spark.createDataFrame([("S1-1", ids)], "a string, b string"), path)
    assert [tuple(r) for r in tsv.read_id_lists(spark, path).collect()] == [("S1-1", ["S2-2"])]
    assert not tsv.exists(spark, path + ".old") and not tsv.exists(spark, path + ".new")


def test_batch_by_model(spark, tmp_path):
    from weftlink.operators import features, training
    from weftlink.plans import batch

    names = [f"{a} {b}" for a in ("acme", "blue", "crown", "delta") for b in ("steel", "tools", "foods", "glass", "paper")]
    raw = [(f"S{s}-{i}", n if s < 3 else n + " ltd", f"{i + 1} main street {10000 + i}", "US") for i, n in enumerate(names) for s in (1, 2)]
    rows = spark.createDataFrame(raw, tsv.ENTITY)
    paths = [str(tmp_path / f"s{i}.tsv") for i in (1, 2, 3)]
    for i in (0, 1):
        tsv.write_entities(rows.where(f"entity_id LIKE 'S{i + 1}-%'"), paths[i])
    own = tsv.normalised(rows).selectExpr("entity_id", "country", "name_clean AS name", "addr_clean AS address")
    pairs = own.where("entity_id LIKE 'S1-%'").selectExpr("entity_id AS s1_id").crossJoin(own.where("entity_id LIKE 'S2-%'").selectExpr("entity_id AS t_id")).selectExpr("*", "int(substr(s1_id, 4) = substr(t_id, 4)) AS label")
    matcher = training.train_matcher(features.pair_features(pairs, own, own), training.MatcherParams(iterations=3, least=1))
    # three rounds leave probabilities far from 1, so the model's own threshold decides; the third table is missing
    done = batch.link(spark, paths[0], paths[1:], str(tmp_path / "out"), batch.by_model(matcher), matcher.threshold)
    found = {r.s1_id: r.ids for r in tsv.read_id_lists(spark, done.matches).collect()}
    assert found == {f"S1-{i}": [f"S2-{i}"] for i in range(len(names))}
    proposed = {r.s1_id: r.ids for r in tsv.read_id_lists(spark, done.candidates).where("s1_id <> 'source1_entity_id'").collect()}
    assert all(set(found[k]) <= set(proposed[k]) for k in found)
