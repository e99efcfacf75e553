"""Live windows over sample index: late rows, restarts, batches that are run again."""

import datetime

import numpy as np
import pandas as pd
import pytest

from epochlake.streaming import live

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "event_id long, user_id long, ts timestamp, value double"


@pytest.fixture
def state_files(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(key)
    live.with_state_files(spark)
    yield
    spark.conf.set(key, had)


def events(spark, rows, path):
    """Rows of (id, user, minute, value) as one more file of a folder."""
    made = [(i, u, START + datetime.timedelta(minutes=m), v) for i, u, m, v in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def plain(rows, width, stride):
    out = set()
    for user in {r[1] for r in rows}:
        v = [r[3] for r in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0]))]
        for win, k in enumerate(range(0, len(v) - width + 1, stride)):
            w = np.array(v[k : k + width])
            out.add((user, win, width, round(w.mean(), 9), round(np.sqrt((w * w).mean()), 9), round(w.max() - w.min(), 9)))
    return out


def got(df):
    rows = df.collect()
    out = {(r.user_id, r.win, r.n, round(r.mean, 9), round(r.rms, 9), round(r.range, 9)) for r in rows}
    assert len(out) == len(rows)
    return out


def test_windows_go_on_after_a_restart_and_late_rows_go(spark, state_files, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, int(k % 3), int(rng.integers(0, 200)), float(np.round(rng.normal(), 3))) for k in range(150)]
    first, second = [r for r in rows if r[2] < 100], [r for r in rows if r[2] >= 100]
    src, path = str(tmp_path / "src"), str(tmp_path / "run")

    def run():
        s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        return got(live.drained(live.sample_windows(s, 8, 3, "10 minutes"), "append", path))

    events(spark, first, src)
    top = max(r[2] for r in first)
    assert run() == plain([r for r in first if r[2] < top - 10], 8, 3)
    late = [(1000, 0, top - 60, 99.0), (1001, 1, top - 30, 99.0)]
    events(spark, late + second, src)  # a new query on the same state; the late rows are behind the watermark
    end = max(r[2] for r in second)
    assert run() == plain([r for r in rows if r[2] < end - 10], 8, 3)
    assert not any(abs(x[3]) > 5 for x in run())


def test_a_batch_that_is_run_again_stands_once(spark, tmp_path):
    docs = spark.createDataFrame([(f"f{k % 5}", START) for k in range(20)], "fp string, ts timestamp")
    src, path = str(tmp_path / "src"), str(tmp_path / "run")
    docs.write.parquet(src)
    stream = lambda: live.first_fingerprints(spark.readStream.schema(docs.schema).parquet(src), "1 hour")
    assert sorted(r.fp for r in live.drained(stream(), "append", path).collect()) == [f"f{k}" for k in range(5)]
    for f in sorted((tmp_path / "run" / "state" / "commits").iterdir()):  # as if the driver had been lost before it could note the batch
        f.unlink()
    assert sorted(r.fp for r in live.drained(stream(), "append", path).collect()) == [f"f{k}" for k in range(5)]


def test_state_is_packed(spark, state_files, tmp_path, monkeypatch):
    """Calls to the state store follow users and batches, not samples; windows without values are rows of nulls."""
    calls = []

    class Kept:
        def __init__(self):
            self.now = []

        def get(self):
            calls.append("get")
            return iter(self.now) if isinstance(self.now, list) else self.now

        def appendValue(self, v):  # noqa: N802
            calls.append("append")
            self.now.append(v)

        def put(self, rows):
            calls.append("put")
            self.now = list(rows)

        def clear(self):
            calls.append("clear")
            self.now = []

        def exists(self):
            return bool(self.now)

        def update(self, v):
            calls.append("update")
            self.now = v

    class Handle:
        getListState = getValueState = lambda self, name, schema: Kept()  # noqa: E731, N815
        listTimers = lambda self: iter([])  # noqa: E731, N815
        registerTimer = lambda self, t: calls.append("timer")  # noqa: E731, N815

    class Times:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = lambda: now

    rng = np.random.default_rng(4)
    minutes = rng.permutation(3000)
    values = [None if m % 7 == 0 or m < 40 else float(np.round(rng.normal(), 3)) for m in minutes]
    frame = pd.DataFrame({"ts": pd.to_datetime(minutes * 60, unit="s"), "us": minutes * 60_000_000, "event_id": minutes, "value": pd.array(values, dtype="Float64").to_numpy(dtype=float, na_value=np.nan)})
    windows = live.SampleWindows(20, 10)
    windows.init(Handle())
    out = []
    for watermark, parts in ((0, [frame[:1000], frame[1000:]]), (1000 * 60_000, []), (3000 * 60_000, [])):
        got_ = windows.handleInputRows((5,), iter(parts), Times(watermark)) if parts else windows.handleExpiredTimer((5,), Times(watermark), None)
        out += [r for df in got_ for r in df.itertuples(index=False)]
    assert len(calls) < 30
    v = np.array([x if x is not None else np.nan for _, x in sorted(zip(minutes.tolist(), values, strict=True), key=lambda r: r[0])])
    assert [r.win for r in out] == list(range(299))
    for r in out:
        own = v[r.win * 10 : r.win * 10 + 20]
        own = own[~np.isnan(own)]
        assert r.n == len(own) and r.start == r.win * 600_000_000 and r.end == r.start + 19 * 60_000_000
        want = (own.mean(), own.var(), own.std(), np.sqrt((own * own).mean()), own.max() - own.min()) if len(own) else (np.nan,) * 5
        assert np.allclose(want, r[5:], equal_nan=True)
