"""Stored runs whose files are neither many small ones nor one large one."""

import os
import uuid

import compare
import duckdb
import pytest

from epochlake.operators import store
from epochlake.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture
def shared(tmp_path, monkeypatch):
    monkeypatch.setattr(store, "scratch", lambda spark: f"{tmp_path}/shared/{uuid.uuid4().hex}")
    return str(tmp_path / "shared")


def connected(path, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    return con


def test_label_files_of_many_users_are_few(spark, shared, tmp_path):
    rows = [(k, None if k % 500 == 0 else k // 4 - 20, None if k % 300 == 0 else f"t{k % 3}") for k in range(2000)]
    rows += [(-1, 7, "a"), (-2, 7, "b"), (None, 7, "c"), (None, None, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    out = registry.queries()["s1_epoch_index"](spark, str(tmp_path))
    con = connected(tmp_path, "events")
    assert not compare.compare(out, con, SQL["s1_epoch_index"])
    assert sum(len(files) for _, _, files in os.walk(shared)) < 100


@pytest.mark.parametrize("langs", [("de", "en", "es", "fr"), ("de", "fr", "it", None), ("en", "es")])
def test_a_language_of_many_files_is_one_folder(spark, shared, tmp_path, monkeypatch, langs):
    monkeypatch.setattr(store.in_files, "__defaults__", (1000,))
    rows = [(k, langs[k % len(langs)], None if k % 97 == 0 else f"word {k} " * 5) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.queries()["s10_file_manifest"](spark, str(tmp_path))
    con = connected(tmp_path, "documents")
    assert not compare.compare(out, con, SQL["s10_file_manifest"])
    folders = [[f for f in files if f.startswith("part-")] for d, _, files in os.walk(shared) if d.endswith("lang=fr")]
    assert "fr" not in langs or len(folders[0]) > 3


def test_a_folder_with_another_set_of_files_is_altered(spark, tmp_path):
    for name, texts in (("a", "pq"), ("b", "pq"), ("c", "pr")):
        (tmp_path / f"lang={name}").mkdir()
        for k, text in enumerate(reversed(texts) if name == "b" else texts):
            (tmp_path / f"lang={name}" / f"part-{k}").write_text(text)
    got = {r.path: (r.size, r.sha256) for r in store.folder_table(store.file_table(spark, str(tmp_path)), r"lang=(\w+)/part").collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == got["b"] != got["c"] and got["a"][0] == 2
