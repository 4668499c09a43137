"""Round trips through files, and the batch run."""

from dataclasses import replace
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from catalens.operators.quality import ValidationError
from catalens.params import QualityRules
from catalens.plans.batch import run_batch
from catalens.schema import ANALYSIS_COLUMNS, CLEAN_COLUMNS, RAW_COLUMNS, text_schema
from catalens.sources import files
from tests.test_cleaning import MESSY, row

TRICKY = [
    row(id=1, title='He said "hi", twice', overview='two\nlines, "quoted"'),
    row(id=2, title="  padded  ", overview="back\\slash\\", genres="a, b"),
    row(id=3, title="   ", overview=None),
    row(id=4, title="ünï", overview="tab\there"),
]


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def as_set(frame):
    return {tuple(r) for r in frame.collect()}


def test_raw_csv_round_trip(spark, raw_frame, folder):
    raw = raw_frame(*TRICKY)
    files.write_raw_csv(raw, f"{folder}/raw")
    back = files.read_raw_csv(spark, f"{folder}/raw")
    assert back.columns == list(RAW_COLUMNS)
    assert {t for _, t in back.dtypes} == {"string"}
    assert as_set(back) == as_set(raw)


def test_raw_csv_follows_the_header_and_skips_bad_lines(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('title,id,note\n"a, b",1,x\nshort,2\nlong,3,x,y\n"q ""q""",4,"l1\nl2"\n,,\n')
    assert files.raw_schema(spark, str(path)).names == ["title", "id", "note"]
    back = files.read_raw_csv(spark, str(path))
    assert as_set(back) == {("a, b", "1", "x"), ('q "q"', "4", "l1\nl2"), (None, None, None)}
    assert back.count() == back.agg(F.count("*")).first()[0] == 3


def test_raw_schema_query_reads_files_of_the_whole_table(spark, monkeypatch):
    from catalens.bindings import queries
    from catalens.bindings.tables import raw_catalog

    sf, read, paths = "/root/testdata/sf0.001", files.raw_schema, []
    monkeypatch.setattr(files, "raw_schema", lambda s, path: paths.append(path) or read(s, path))
    assert [r["column_name"] for r in queries._raw_schema(spark, sf).collect()] == list(RAW_COLUMNS)
    assert files.read_raw_csv(spark, paths[0], text_schema()).count() == raw_catalog(spark, sf).count()


def test_files_without_line_breaks_are_split(spark, raw_frame, folder):
    raw = raw_frame(*[row(id=i, title=f'T "{i}", ok') for i in range(200)])
    files.write_raw_csv(raw.coalesce(1), f"{folder}/raw")
    assert files.read_whole_csv(spark, f"{folder}/raw", text_schema()).rdd.getNumPartitions() == 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        split = files.read_raw_csv(spark, f"{folder}/raw", line_breaks=False)
        assert split.rdd.getNumPartitions() > 1
        assert as_set(split) == as_set(raw)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers_in_another_order_fail(spark, folder):
    spark.createDataFrame([("1", "A")], "id string, title string").write.option("header", True).csv(f"{folder}/mixed")
    other = spark.createDataFrame([("B", "2")], "title string, id string")
    other.write.mode("append").option("header", True).csv(f"{folder}/mixed")
    schema = text_schema(["id", "title"])
    for line_breaks in (True, False):
        with pytest.raises(Exception, match="(?i)header"):
            files.read_raw_csv(spark, f"{folder}/mixed", schema, line_breaks).collect()


def test_a_count_leaves_out_malformed_lines(spark, folder):
    text = "id,title\n1,A\n2,B,too many\n3,C"
    spark.createDataFrame([(text,)], "line string").coalesce(1).write.text(f"{folder}/bad")
    for line_breaks in (True, False):
        raw = files.read_raw_csv(spark, f"{folder}/bad", line_breaks=line_breaks)
        assert raw.count() == 2 and as_set(raw) == {("1", "A"), ("3", "C")}


def test_an_unfinished_table_is_not_reused(spark, four, folder):
    files.materialise(four, f"{folder}/broken")
    (Path(folder.removeprefix("file:")) / "broken/_SUCCESS").unlink()
    assert files.read_clean_if_present(spark, f"{folder}/broken") is None


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda name, default: default)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            files.shared_folder(SimpleNamespace(conf=conf, sparkContext=context))


def test_folders_can_be_removed(spark, four):
    path = files.shared_folder(spark)
    files.materialise(four, path)
    assert files.exists(spark, path)
    files.remove(spark, path)
    assert not files.exists(spark, path)


def test_clean_table(spark, four, folder):
    path = f"{folder}/clean"
    assert files.read_clean_if_present(spark, path) is None
    back = files.materialise(four, path)
    assert as_set(back) == as_set(four)
    assert files.read_clean(spark, path, ["id"]).columns == ["id"]
    assert files.read_clean(spark, path).columns == list(ANALYSIS_COLUMNS)
    assert files.read_clean_if_present(spark, path).count() == 4
    names = {p.name.split(".", 1)[1] for p in Path(path).glob("part-*")}
    assert names == {"zstd.parquet"}


def test_view_and_preview(spark, four):
    files.register_view(four, "films")
    assert spark.sql("SELECT count(*) AS n FROM films WHERE vote_count >= 80").first().n == 3
    assert [r.id for r in files.preview(four, 2).collect()] == [1, 2]


def test_report_csv(spark, four, folder):
    path = files.write_report_csv(four.select("id", "title"), folder, "small")
    assert as_set(spark.read.csv(path, header=True, schema="id long, title string")) == {
        (1, "A"), (2, "B"), (3, "C"), (4, "D"),
    }
    files.export_clean_csv(four.select("id", "genres"), f"{folder}/export", sep="|")
    back = spark.read.csv(f"{folder}/export", header=True, sep="|", schema="id long, genres string")
    assert as_set(back) == as_set(four.select("id", "genres"))


def test_shared_folder_uses_the_configured_place(spark):
    assert files.shared_folder(spark) != files.shared_folder(spark)
    configured = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://cluster/shared/"})
    assert files.shared_folder(configured).startswith("hdfs://cluster/shared/catalens-")


@pytest.fixture
def raw_path(raw_frame, folder):
    rows = [*MESSY, *[row(id=i, title=f"Title {i}", genres="Drama", vote_count=str(i)) for i in range(100, 130)]]
    files.write_raw_csv(raw_frame(*rows), f"{folder}/raw")
    return f"{folder}/raw"


def test_batch(spark, raw_path, folder, low_gates):
    result = run_batch(spark, raw_path, f"{folder}/out", gates=low_gates)
    assert result.cleaned.columns == list(CLEAN_COLUMNS)
    summary = result.summary.first()
    assert (summary.raw_rows, summary.clean_rows, summary.dropped_rows) == (35, 31, 4)
    assert {(r.gate, r.passed) for r in result.report.collect()} == {("raw", True), ("clean", True)}
    kpis = result.kpis.first()
    assert kpis.total_movies == 31
    genres = spark.read.csv(result.table_paths["genre_stats"], header=True, inferSchema=False)
    assert as_set(genres.select("genre", "movie_count")) == {("Drama", "31"), ("Action", "1")}
    assert set(result.table_paths) >= {"top_rated", "yearly_trend", "kpis", "validation"}

    again = run_batch(spark, raw_path, f"{folder}/out", gates=low_gates, reuse_clean=True)
    assert again.summary.first().note == "clean skipped"
    assert again.kpis.first() == kpis


def test_batch_names_missing_columns(spark, raw_frame, folder):
    lacking = raw_frame(*MESSY).drop("title", "keywords")
    files.write_raw_csv(lacking, f"{folder}/lacking")
    with pytest.raises(ValidationError, match="required_columns"):
        run_batch(spark, f"{folder}/lacking", f"{folder}/out", gates=QualityRules(hard_fail=True))
    report = run_batch(spark, f"{folder}/lacking", f"{folder}/out", gates=QualityRules()).report
    assert report.where("name = 'required_columns'").first().detail == "missing: ['title']"


def test_batch_without_line_breaks(spark, raw_path, folder, low_gates):
    result = run_batch(spark, raw_path, f"{folder}/flat", gates=low_gates, line_breaks=False, schema=text_schema(RAW_COLUMNS))
    assert result.summary.first().raw_rows == 35


def test_batch_stops_on_a_failed_gate(spark, raw_path, folder):
    strict = QualityRules(hard_fail=True, min_raw_rows=36, min_clean_rows=1)
    with pytest.raises(ValidationError, match="min_raw_rows"):
        run_batch(spark, raw_path, f"{folder}/out", gates=strict)
    with pytest.raises(ValidationError, match="min_clean_rows"):
        run_batch(spark, raw_path, f"{folder}/out", gates=replace(strict, min_raw_rows=1, min_clean_rows=99))
