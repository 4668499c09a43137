"""CSV with line breaks in quoted texts, read in splits, against the same files read whole."""

import random
from collections import Counter

import numpy as np
import pytest

from catalens.schema import text_schema
from catalens.sources import files, split_csv


@pytest.fixture
def small_splits(spark):
    """Sets the bytes of a split and the rows of an Arrow batch."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"]

    def cut(size, rows=10_000):
        for name, value in zip(names, (size, 1, rows)):
            spark.conf.set(name, str(value))

    yield cut
    for name in names:
        spark.conf.unset(name)


def rows(frame):
    return Counter(map(tuple, frame.collect()))


def field(rnd, size=9):
    text = "".join(rnd.choice('ab,"\n é') for _ in range(rnd.randint(0, size)))
    return '"' + text.replace('"', '""') + '"' if rnd.random() < 0.4 or any(c in text for c in ',"\n') else text


@pytest.mark.parametrize("seed", range(3))
def test_random_files_and_split_points(spark, tmp_path, small_splits, seed):
    rnd = random.Random(seed)
    names = [f"c{i}" for i in range(rnd.randint(2, 4))]
    for part in range(3):
        end = rnd.choice(["\n", "\r\n"])
        lines = [",".join(field(rnd) for _ in range(len(names) + (rnd.random() < 0.1))) for _ in range(rnd.randint(0, 40))]
        lines.insert(len(lines) // 2, "")
        (tmp_path / f"{part}.csv").write_bytes(end.join([",".join(names), *lines, ""][: None if part else -1]).encode())
    schema = text_schema(names)
    whole = rows(files.read_whole_csv(spark, str(tmp_path), schema))
    for size in (rnd.randint(15, 60), rnd.randint(60, 400)):
        small_splits(size, rnd.randint(1, 20))
        assert rows(files.read_raw_csv(spark, str(tmp_path), schema)) == whole, size


@pytest.mark.parametrize("seed", range(3))
def test_quotes_out_of_place(spark, tmp_path, small_splits, seed):
    """Anything goes, as long as the last record is closed."""
    rnd = random.Random(100 + seed)
    schema = text_schema(["x", "y"])
    for part in range(4):
        text = "".join(rnd.choice('ab,""\n ') for _ in range(200))
        after = split_csv.states_after(False, *_steps(text.split("\n")))
        (tmp_path / f"{part}.csv").write_text("x,y\n" + text + ('",\n' if after[-1] else "\n"))
    whole = rows(files.read_whole_csv(spark, str(tmp_path), schema))
    for size in (60,):
        small_splits(size)
        assert rows(files.read_raw_csv(spark, str(tmp_path), schema)) == whole


def _steps(lines):
    import re

    outside = [re.match(split_csv.CLOSED_FROM_OUTSIDE.replace(r"\z", r"\Z"), line) is None for line in lines]
    inside = [re.match(split_csv.CLOSED_FROM_INSIDE.replace(r"\z", r"\Z"), line) is None for line in lines]
    return np.array(outside), np.array(inside)


def test_states_follow_the_lines_one_by_one():
    rnd = np.random.RandomState(3)
    for _ in range(200):
        outside, inside = rnd.rand(2, rnd.randint(1, 30)) < 0.5
        for first in (False, True):
            state, expected = first, []
            for a, b in zip(outside, inside):
                state = bool(b if state else a)
                expected.append(state)
            assert split_csv.states_after(first, outside, inside).tolist() == expected


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    text = "".join(f'{i},"line one of {i}\nline ""two"", {i}"\n' for i in range(3000))
    (tmp_path / "big.csv").write_text("id,note\n" + text)
    small_splits(4096)
    frame = files.read_raw_csv(spark, str(tmp_path / "big.csv"))
    assert frame.rdd.getNumPartitions() > 20
    assert rows(frame) == Counter((str(i), f'line one of {i}\nline "two", {i}') for i in range(3000))
    assert files.read_whole_csv(spark, str(tmp_path / "big.csv"), text_schema(["id", "note"])).rdd.getNumPartitions() == 1


def test_records_over_many_splits_and_headers_with_line_breaks(spark, tmp_path, small_splits):
    long = "\n".join(f"row {i}" for i in range(200))
    (tmp_path / "a.csv").write_text(f'"i\nd",note\n1,"{long}"\n2,"{long}"\n')
    schema = text_schema(["i\nd", "note"])
    for size in (40, 300):
        small_splits(size)
        assert rows(files.read_raw_csv(spark, str(tmp_path), schema)) == Counter([("1", long), ("2", long)])
    with pytest.raises(Exception, match="header"):
        files.read_raw_csv(spark, str(tmp_path), text_schema(["id", "note"])).collect()


def test_malformed_lines_can_be_kept(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('id,note\n1,"a\nb"\n2\n3,x,y\n\n4,"never closed\n5,z\n')
    for size, breaks in ((7, True), (1 << 20, True), (1 << 20, False)):
        small_splits(size)
        kept = files.read_raw_csv(spark, str(tmp_path), text_schema(["id", "note"]), breaks, keep_malformed=True)
        assert kept.columns == ["id", "note", split_csv.MALFORMED]
        if breaks:
            assert {r[2] for r in kept.collect()} == {None, "2", "3,x,y"}
            good = [r[:2] for r in kept.collect() if r[2] is None]
            assert sorted(good) == [("1", "a\nb"), ("4", "never closed\n5,z")]


def test_a_record_beyond_the_limit_is_malformed(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('id,note\n1,a\n2,"' + "never closed\n" * 100)
    small_splits(64)
    states = files.materialise(split_csv.split_states(spark, str(tmp_path)), files.shared_folder(spark))
    names = ("id", "note")
    found = split_csv.records(spark, str(tmp_path), names, states, max_record=500)
    assert rows(split_csv.parse(found, names)) == Counter([("1", "a")])
    assert split_csv.parse(found, names, keep_malformed=True).count() == 2


def test_files_of_every_kind_of_end(spark, tmp_path):
    schema = text_schema(["id", "note"])
    for name, text in {"empty": "", "header": "id,note", "line": "id,note\n", "plain": "id,note\n1,a", "crlf": 'id,note\r\n2,"b\r\nc"\r\n'}.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    assert rows(files.read_raw_csv(spark, str(tmp_path), schema)) == Counter([("1", "a"), ("2", "b\r\nc")])
