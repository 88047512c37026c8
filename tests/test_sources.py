from caseflow.sources import files as FS


def test_discover_and_latest_per_state(spark, feed_root):
    files = FS.discover_files(spark, f"{feed_root}/state/data/states")
    assert files.count() == 3
    latest = {r["parent"]: r["file_name"] for r in FS.latest_file_per_group(files).collect()}
    assert latest == {"CA": "20240301-120000_CA_team.csv", "TX": "20240215-080000_TX_team.csv"}


def test_missing_directory_is_empty(spark, feed_root):
    assert FS.discover_files(spark, f"{feed_root}/nope").count() == 0
    assert FS.read_state_feed(spark, f"{feed_root}/nope") is None
    assert FS.read_weekly_feed(spark, f"{feed_root}/nope") is None


def test_state_feed_union_by_name(spark, feed_root):
    raw = FS.read_state_feed(spark, f"{feed_root}/state")
    assert raw.count() == 7
    assert {"state", "geo_name", "disease_subtype", "confirmation_status"} <= set(raw.columns)
    assert raw.where("state = 'TX' and confirmation_status is not null").count() == 0
    assert all(t == "string" for _, t in raw.dtypes)
    assert raw.where("count = '999'").count() == 0          # the older CA upload is ignored


def test_weekly_feed_newest_file(spark, feed_root):
    raw = FS.read_weekly_feed(spark, f"{feed_root}/weekly")
    assert raw.count() == 9
    assert raw.where("`Current week` = '500'").count() == 0
    assert raw.where("`Current week` = '1,234'").count() == 1


def test_load_all_skips_invalid_source(spark, feed_root):
    from pyspark.sql import functions as F

    from caseflow.operators.conform import load_state_feed, load_weekly_feed
    from caseflow.plans.catalog import load_all

    def broken(s):  # a null disease name in one row rejects the whole source
        return load_state_feed(FS.read_state_feed(s, f"{feed_root}/state")
                               .withColumn("disease_name", F.when(F.col("count") == "5", None)
                                           .otherwise(F.col("disease_name"))))

    def missing_state(s):
        return load_state_feed(FS.read_state_feed(s, f"{feed_root}/state").drop("state", "reporting_jurisdiction"))

    facts, report = load_all(spark, {"tracker": broken, "nndss": lambda s: load_weekly_feed(
        FS.read_weekly_feed(s, f"{feed_root}/weekly")), "zzz": missing_state})
    status = {r["source"]: r["status"] for r in report.collect()}
    assert status == {"nndss": "loaded", "tracker": "invalid", "zzz": "error"}
    assert {r["data_source"] for r in facts.select("data_source").distinct().collect()} == {"nndss"}


def test_write_facts_roundtrip(spark, fixture_facts, tmp_path):
    from caseflow.plans.catalog import open_or_build, valid_sources, write_facts
    path = str(tmp_path / "facts")
    back = write_facts(fixture_facts, path)
    assert back.count() == fixture_facts.count()
    assert back.columns == fixture_facts.columns
    assert valid_sources(back) == {"nndss": 0, "tracker": 0}
    again = open_or_build(spark, path, lambda: (_ for _ in ()).throw(AssertionError("rebuilt")))
    assert again.count() == back.count()


def test_mixed_jurisdiction_columns_reject_source(spark, feed_root):
    """Defaults and mirroring look at the combined feed: a column missing in one upload
    leaves nulls there, so validation rejects the whole source (feed parity)."""
    from caseflow.operators.conform import load_state_feed
    from caseflow.plans.catalog import load_all
    facts, report = load_all(spark, {"tracker": lambda s: load_state_feed(
        FS.read_state_feed(s, f"{feed_root}/mixed"))})
    assert report.first()["status"] == "invalid"
    assert facts.count() == 0


def test_build_fact_table_end_to_end(spark, feed_root, tmp_path):
    from caseflow.plans.catalog import build_fact_table
    facts, merged, report = build_fact_table(spark, str(tmp_path / "facts"), f"{feed_root}/state",
                                             f"{feed_root}/weekly")
    assert {r["source"]: r["status"] for r in report.collect()} == {"nndss": "loaded", "tracker": "loaded"}
    assert facts.count() == 13 and merged.count() == 7
    got = spark.sql("SELECT disease_name, SUM(count) AS c FROM disease_data_merged GROUP BY 1 ORDER BY 1").collect()
    assert [(r["disease_name"], r["c"]) for r in got] == [("measles", 1274), ("meningococcus", 13)]
    assert spark.sql("SELECT count(*) AS n FROM disease_name_mapping").first()["n"] == 4


GOOD = "report_period_start,state,disease_name,count\n2024-01-07,CA,measles,10\n2024-01-14,CA,measles,5\n"


def uploads(tmp_path, **files):
    for state, text in files.items():
        folder = tmp_path / "data" / "states" / state
        folder.mkdir(parents=True)
        (folder / f"20240301-120000_{state}_team.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path)


FAULTY = {
    "CA": GOOD, "TX": GOOD + "2024-01-21,TX,measles,1,2\n", "NY": GOOD + "2024-01-21,NY\n",
    "GA": GOOD.encode() + "2024-01-21,GA,Mühle,1\n".encode("latin-1"), "MA": "\n\n",
    "AL": '﻿\n"report_period_start","state","disease_name","count"\n2024-01-07,AL,"a ""quoted"",\nbroken line",3\n',
}


def test_faulty_uploads_are_told_and_counted(spark, tmp_path):
    root = uploads(tmp_path, **FAULTY)
    told = FS.read_feed(spark, FS.state_feed_paths(spark, root))
    by_state = {r["path"].split("/")[-2]: tuple(r)[1:] for r in told.report.collect()}
    assert by_state == {"CA": ("read", 2, 0, 0), "TX": ("skipped", 3, 0, 1), "NY": ("read", 3, 1, 0), "GA": ("skipped", 3, 0, 1),
                        "MA": ("skipped", 0, 0, 0), "AL": ("read", 1, 0, 0)}
    assert sorted((r["path"].split("/")[-2], r["reason"], r["record"]) for r in told.quarantine.collect() if r["record"]) == [
        ("GA", FS.BYTES, "2024-01-21,GA,M�hle,1"), ("NY", FS.SHORT, "2024-01-21,NY"), ("TX", FS.LONG, "2024-01-21,TX,measles,1,2")]
    assert told.quarantine.where("record IS NULL").count() == 1
    got = sorted(((r["state"], r["disease_name"], r["count"]) for r in told.rows.collect()), key=str)
    assert got == sorted([("CA", "measles", "10"), ("CA", "measles", "5")] * 2 + [("NY", None, None), ("AL", 'a "quoted",\nbroken line', "3")], key=str)


def test_quarantine_keeps_the_other_rows_and_raise_ends_the_load(spark, tmp_path):
    import pytest
    root = uploads(tmp_path, **{k: FAULTY[k] for k in ("CA", "TX", "NY", "GA")})
    rows = FS.read_state_feed(spark, root, "quarantine")
    assert rows.count() == 9 and rows.where("state IN ('TX', 'GA')").count() == 0
    with pytest.raises(ValueError, match="do not fit its header"):
        FS.read_state_feed(spark, root, "raise")
    with pytest.raises(ValueError, match="on_error"):
        FS.read_state_feed(spark, root, "ignore")
    lines = FS.read_state_feed(spark, root, "quarantine", multi_line=False)         # the mode that splits files
    assert sorted(map(str, lines.collect())) == sorted(map(str, rows.collect()))


def test_uploads_written_are_the_layout_read(spark, tmp_path):
    raw = spark.createDataFrame([("CA", "1"), ("CA", "2"), ("N Y", "3"), (None, "4")], "state string, count string")
    FS.write_state_feed(raw, str(tmp_path), "20240301-000000", "a")
    FS.write_state_feed(raw.limit(1), str(tmp_path), "20240201-000000", "b")           # delivered later, dated earlier
    assert sorted((r["parent"], r["file_name"]) for r in FS.discover_files(spark, f"{tmp_path}/data/states").collect()) == [
        ("CA", "20240201-000000_CA_b.csv"), ("CA", "20240301-000000_CA_a.csv"), ("N Y", "20240301-000000_N Y_a.csv")]
    assert sorted((r["reporting_jurisdiction"], r["count"]) for r in FS.read_state_feed(spark, str(tmp_path)).collect()) == [
        ("CA", "1"), ("CA", "2"), ("N Y", "3")]
    FS.write_weekly_feed(raw, str(tmp_path), "20240310")
    FS.write_weekly_feed(raw.limit(1), str(tmp_path), "20240309")
    assert FS.read_weekly_feed(spark, str(tmp_path)).count() == 4


def test_weekly_uploads_are_files_or_folders_of_parts(spark, tmp_path):
    raw = spark.range(1000).selectExpr("concat('a, ', id) AS state", "cast(id AS string) AS count").repartition(5)
    FS.write_weekly_feed(raw, str(tmp_path), "20240310")
    parts = [f for f in (tmp_path / "NNDSS_Weekly_Data_20240310.csv").iterdir() if f.name.startswith("part-")]
    assert len(parts) > 1                                        # no single writer
    assert sorted(map(tuple, FS.read_weekly_feed(spark, str(tmp_path)).collect())) == sorted(map(tuple, raw.collect()))
    FS.write_weekly_feed(raw.limit(3), str(tmp_path), "20240310")        # replaced, not added to
    assert FS.read_weekly_feed(spark, str(tmp_path)).count() == 3
    (tmp_path / "NNDSS_Weekly_Data_20240401.csv").write_text("state,count\nCA,1\n")
    assert FS.read_weekly_feed(spark, str(tmp_path)).count() == 1
    FS.write_weekly_feed(raw, str(tmp_path), "20240501")
    part = next(f for f in (tmp_path / "NNDSS_Weekly_Data_20240501.csv").iterdir() if f.name.startswith("part-"))
    part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    part.write_text(part.read_text() + "x,1,2,3\n")
    assert FS.read_weekly_feed(spark, str(tmp_path)).count() == 0         # an upload with a faulty part is left out whole
    assert FS.read_weekly_feed(spark, str(tmp_path), "quarantine").count() == 1000


def test_large_files_are_split_only_where_no_line_break_is_quoted(spark, tmp_path, monkeypatch):
    head = "state,note,count\n"
    texts = {"plain": "CA,x,1\n\nTX,,2\n", "quoted": 'CA,"a, ""b""",1\nTX,"",2\n', "crlf": "CA,x,1\r\nTX,y,2\r\n",
             "broken": 'CA,"a\nb",1\n', "inner": 'CA,5" pipe,1\nTX,"6\n",2\n', "spaced": 'CA, "a,1\nTX,b" ,2\n', "blank": "CA,x,1\n  \nTX,y,2\n",
             "lone": "CA,x\ry,1\nTX,y,2\n", "even": 'CA,5",",1\nTX,z",2\n'}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(((head.replace("\n", "\r\n") if name == "crlf" else head) + text).encode())
    paths = [str(tmp_path / f"{name}.csv") for name in texts]
    assert FS._one_line_records(spark, paths) == set()                   # none is large
    read = [p for p in paths if "lone" not in p]
    before = sorted(map(str, FS.read_feed(spark, read, "quarantine").rows.collect()))
    monkeypatch.setattr(FS, "LARGE_FILE", 1)
    assert {p.split("/")[-1][:-4] for p in FS._one_line_records(spark, paths)} == {"plain", "quoted", "crlf"}
    assert sorted(map(str, FS.read_feed(spark, read, "quarantine").rows.collect())) == before


def test_a_cluster_without_a_shared_folder_is_an_error():
    import pytest

    from caseflow.session import ensure_checkpoint_dir

    class Session:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session)
