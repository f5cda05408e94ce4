"""Sales joined with the version of their client that was valid when they were sold, in numbered batches of a stateful stream.

Both tables are dealt to batches by the day they came in. Each batch is a new start of one transformWithState query on one
checkpoint. Its state holds sorted versions and waiting sales, in Arrow blocks; an injected clock row carries both watermarks of the batch.
In a batch, changes below their watermark are late; sales sold before the smaller watermark (or at no known time) look up the last
version by bisection and are emitted; then all versions up to that watermark but a client's last are pruned.

State is kept per client, many clients to a key of the stream, as a call per key costs milliseconds. A client with more than HOT rows
is split into units by time, which keep their state apart, in other keys; what a sale needs from other units of its client
(how many versions they hold, the last one below) is joined after the stream, from one summary row per unit and batch.

Nulls: a sale without client has no versions (n_held 0), a change without client is held for nobody but may be late; a change without
valid_at is left out; null seq and change_id come first in order. Rows without arrival fall into the last batch, rows before the first
day into the first. Repeated changes count once (whole rows), repeated sales each. Texts are not used; other columns are ignored
beside telling changes apart. Empty tables give no rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from peakforge.llm.store import drop, new_path, small, written

FIRST_DAY, DAYS, BATCHES, LAG_HOURS = 19723, 152, 10, 36
#: A client with more rows is split into units of about UNIT rows; a key of the stream holds about BUCKET rows of all batches.
HOT, UNIT, BUCKET = 4096, 1024, 32768
#: Stands for null, and for a watermark of minus infinity, where pandas would turn a long into a double.
NULL, TOP = -(1 << 63), (1 << 63) - 1
CLOCK, CHANGE, SALE = 0, 1, 2

_LONG, _FLAG = pa.int64(), pa.bool_()
_HELD = pa.schema([("client", _LONG), ("split", _FLAG), ("seg", _LONG), ("time", _LONG), ("seq", _LONG), ("id", _LONG), ("cents", _LONG), ("op", pa.string()), ("kept", _FLAG)])
_WAITING = pa.schema([("client", _LONG), ("known", _FLAG), ("split", _FLAG), ("seg", _LONG), ("time", _LONG), ("id", _LONG)])
#: Rows in a value of a ListState: a value a row would be pickled and copied one by one.
BLOCK = 8192
_OUT = "rec string, id long, batch int, n_held long, change_id long, balance_cents long, op string, client long, split boolean, seg long, sold boolean, found boolean, kept boolean, has_kept boolean"
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every store takes megabytes of disk ahead
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # the next start opens the stores anew
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def _whole(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NULL))


def _micros(t: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time, by its parts, so that no time zone plays a part; null: NULL."""
    day = F.unix_date(t.cast("date")).cast("long")
    return F.coalesce(((day * 24 + F.hour(t)) * 60 + F.minute(t)) * F.lit(60_000_000) + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long"), F.lit(NULL))


def _batch(day: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), F.floor((day - FIRST_DAY) * BATCHES / DAYS).cast("int"))).alias("batch")


def _rows(sales: DataFrame, changes: DataFrame) -> DataFrame:
    """Both tables as rows of one shape, numbered by batch."""
    client = [F.coalesce("client_id", F.lit(0)).cast("long").alias("client"), F.col("client_id").isNotNull().alias("known")]
    none = F.lit(NULL)
    s = sales.select(
        F.lit(SALE).alias("kind"), *client, _micros(F.col("sold_at")).alias("time"), none.alias("seq"), _whole(F.col("sale_id")).alias("id"),
        none.alias("cents"), F.lit(None).cast("string").alias("op"), _batch(F.unix_date(F.col("arrived_at").cast("date"))),
    )
    shift = F.crc32(F.col("change_id").cast("string").cast("binary")) % 4
    c = changes.where("valid_at is not null").distinct().select(
        F.lit(CHANGE).alias("kind"), *client, _micros(F.col("valid_at")).alias("time"), _whole(F.col("seq")).alias("seq"), _whole(F.col("change_id")).alias("id"),
        _whole(F.floor(100 * F.col("balance") + 0.5)).alias("cents"), "op", _batch(F.unix_date(F.col("valid_at").cast("date")) + shift),
    )
    return s.unionByName(c)


def _units(rows: DataFrame, hot: int, unit: int) -> tuple[DataFrame, DataFrame]:
    """rows with split and seg: seg numbers the stretches of time, equally wide, of a client that is split; the table of these clients.

    The width follows from the client's rows and its times within the days of the batches, so that a broken date doesn't stretch it.
    """
    per = ["client", "known"]
    day = 86_400_000_000
    at = F.when(F.col("time") != NULL, F.greatest(F.lit(FIRST_DAY * day), F.least(F.lit((FIRST_DAY + DAYS) * day), F.col("time"))))
    of = rows.groupBy(*per).agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).where(F.col("n") > hot)
    parts = F.ceil(F.col("n") / unit)
    width = F.greatest(F.lit(1), F.coalesce(((F.col("high") - F.col("low")) / parts).cast("long"), F.lit(1)))
    spread = written(of.select(*per, parts.alias("parts"), F.coalesce("low", F.lit(0)).alias("low"), width.alias("width")), "spreads")
    seg = F.when(F.col("time") == NULL, F.pmod(F.xxhash64("id"), "parts")).otherwise(F.floor((F.col("time") - F.col("low")) / F.col("width")))
    joined = rows.join(small(spread), per, "left").withColumns({"split": F.col("parts").isNotNull(), "seg": F.coalesce(seg, F.lit(0)).cast("long")})
    return joined.drop("parts", "low", "width"), spread


def _watermarks(rows: DataFrame) -> list[tuple[int, int]]:
    """Both watermarks for each batch: from the largest times of earlier batches; for the flush after the last, no bound."""
    top = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("time")))
    found = {r[0]: r[1:] for r in rows.groupBy("batch").agg(top(SALE), top(CHANGE)).collect()}  # BATCHES rows at most
    marks, largest = [], [NULL, NULL]
    for b in range(BATCHES):
        marks.append(tuple(x - LAG_HOURS * 3_600_000_000 if x != NULL else NULL for x in largest))
        largest = [max(x, y if y is not None else NULL) for x, y in zip(largest, found.get(b, (None, None)), strict=True)]
    return [*marks, (TOP, TOP)]


def _clock(spark: SparkSession, marks: list[tuple[int, int]], buckets: int) -> DataFrame:
    """A row for every key and batch: both watermarks, in the places of time and seq, and the batch as id."""
    b = F.col("id") % len(marks)
    pick = lambda i: F.element_at(F.array(*[F.lit(m[i]) for m in marks]), b.cast("int") + 1)
    return spark.range(buckets * len(marks)).select(
        F.lit(CLOCK).alias("kind"), F.lit(0).cast("long").alias("client"), F.lit(False).alias("known"), pick(0).alias("time"), pick(1).alias("seq"), b.alias("id"), F.lit(NULL).alias("cents"),
        F.lit(None).cast("string").alias("op"), b.cast("int").alias("batch"), F.lit(False).alias("split"), F.lit(0).cast("long").alias("seg"), F.floor(F.col("id") / len(marks)).alias("bucket"),
    )


def _held(state, schema: pa.Schema) -> dict[str, np.ndarray]:
    """The rows of a ListState of Arrow blocks, as arrays."""
    blocks = [b for (x,) in state.get() for b in pa.ipc.open_stream(x)]
    whole = pa.Table.from_batches(blocks, schema)
    return {n: whole.column(n).to_numpy() for n in schema.names}


def _hold(state, schema: pa.Schema, before: int, rows: dict[str, np.ndarray]) -> None:
    """Put rows, in their order, into a ListState that had so many."""
    whole = pa.table({n: pa.array(rows[n], schema.field(n).type) for n in schema.names}, schema)
    blocks = []
    for b in whole.to_batches(BLOCK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as out:
            out.write_batch(b)
        blocks.append((sink.getvalue().to_pybytes(),))
    if blocks:
        state.put(blocks)
    elif before:
        state.clear()


def _joined(a: dict, b: dict) -> dict[str, np.ndarray]:
    return {k: np.concatenate([a[k], b[k]]) for k in a}


def _longs(x: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(x.astype(np.int64), x == NULL)


class Enrich(StatefulProcessor):
    """Holds versions, sorted by client, unit, time, seq and id, and the sales that wait."""

    def init(self, handle) -> None:
        self.held, self.waiting = handle.getListState("held", "block binary"), handle.getListState("waiting", "block binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        clock = new[new["kind"] == CLOCK].iloc[0]
        batch, late_below = int(clock["id"]), int(clock["seq"])
        until = min(int(clock["time"]), late_below)

        changes = new[new["kind"] == CHANGE]
        late = changes[changes["time"] < late_below]
        yield from self._emitted("late", late["id"].to_numpy(), batch)
        fresh = changes[(changes["time"] >= late_below) & changes["known"]]
        old = _held(self.held, _HELD)
        v = _joined(old, {n: np.zeros(len(fresh), bool) if n == "kept" else fresh[n].to_numpy() for n in _HELD.names})
        order = np.lexsort((v["id"], v["seq"], v["time"], v["seg"], v["client"]))
        v = {n: x[order] for n, x in v.items()}

        waited = _held(self.waiting, _WAITING)
        sales = new[new["kind"] == SALE]
        s = _joined(waited, {n: sales[n].to_numpy() for n in _WAITING.names})
        is_due = (s["time"] == NULL) | (s["time"] < until) | (until == TOP)
        due = {n: x[is_due] for n, x in s.items()}

        n = len(v["id"])
        rank = lambda c: np.unique(np.concatenate([v[c], due[c]]), return_inverse=True)
        (_, client), (segs, seg), (times, time) = rank("client"), rank("seg"), rank("time")
        unit = client * len(segs) + seg
        at = unit * len(times) + time  # bisection by unit and time at once
        first, last = np.searchsorted(unit[:n], unit[n:], "left"), np.searchsorted(unit[:n], unit[n:], "right")
        place = np.searchsorted(at[:n], at[n:], "right") - 1
        found = (place >= first) & due["known"] & (due["time"] != NULL)
        yield from self._emitted("sale", due["id"], batch, np.where(due["known"], last - first, 0), v, place, found, due)
        yield from self._summaries(v, due, unit, n, batch)

        below = v["time"] <= until
        following = np.zeros(n, bool)  # another version up to the watermark follows in the unit
        following[:-1] = (unit[:n][:-1] == unit[:n][1:]) & below[1:]
        stay = ~(below & following)
        v["kept"] = below
        _hold(self.held, _HELD, len(old["id"]), {c: x[stay] for c, x in v.items()})
        _hold(self.waiting, _WAITING, len(waited["id"]), {c: x[~is_due] for c, x in s.items()})

    def close(self) -> None:
        pass

    @staticmethod
    def _emitted(rec: str, ids: np.ndarray, batch: int, n_held=None, v=None, place=None, found=None, unit=None, has_kept=None) -> Iterator[pd.DataFrame]:
        n = len(ids)
        if not n:
            return
        none, no = np.full(n, NULL), np.zeros(n, bool)
        if found is None:
            found = no
        pick = lambda c: np.where(found, v[c][place], NULL) if v is not None and len(v[c]) else none
        some = v is not None and len(v["op"]) > 0
        yield pd.DataFrame({
            "rec": rec, "id": _longs(ids), "batch": np.full(n, batch, np.int32), "n_held": _longs(none if n_held is None else n_held), "change_id": _longs(pick("id")), "balance_cents": _longs(pick("cents")),
            "op": np.where(found, v["op"][place], None) if some else np.full(n, None, object), "client": unit["client"] if unit else none, "split": unit["split"] & unit.get("known", True) if unit else no, "seg": unit["seg"] if unit else none,
            "sold": unit["time"] != NULL if unit and "time" in unit else no, "found": found, "kept": found & v["kept"][place] if some else no, "has_kept": no if has_kept is None else has_kept,
        })

    def _summaries(self, v: dict, due: dict, unit: np.ndarray, n: int, batch: int) -> Iterator[pd.DataFrame]:
        """Of each unit of a split client: how many versions it holds before pruning, whether one of them outlived a pruning, the last one."""
        split = np.concatenate([v["split"], due["split"] & due["known"]])
        units, where = np.unique(unit[split], return_index=True)
        if not len(units):
            return
        own = {c: np.concatenate([v[c], due[c]])[split][where] for c in ("client", "split", "seg")}
        first, last = np.searchsorted(unit[:n], units, "left"), np.searchsorted(unit[:n], units, "right")
        outlived = np.concatenate([[0], np.cumsum(v["kept"])])
        yield from self._emitted("unit", np.full(len(units), NULL), batch, last - first, v, last - 1, last > first, own, outlived[last] > outlived[first])


def _resolved(out: DataFrame) -> DataFrame:
    """Emitted rows of the stream; those of split clients with what the other units of their client hold."""
    per = ["client", "batch"]
    version = F.struct("seg", "change_id", "balance_cents", "op", "kept")
    units = out.where("rec = 'unit'").select(*per, "seg", F.floor(F.col("seg") / 1024).alias("part"), F.col("n_held").alias("n"), "has_kept", F.when(F.col("found"), version).alias("last"))
    whole = units.groupBy(*per).agg((F.sum(F.col("n") - F.col("has_kept").cast("int")) + F.max(F.col("has_kept").cast("int"))).alias("all_held"), F.max(F.when(F.col("has_kept"), F.col("seg"))).alias("top_kept"))
    before = lambda keys, by: F.last("last", True).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    parts = units.groupBy(*per, "part").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("seg"))).alias("last"))
    parts = parts.select(*per, "part", before(per, "part").alias("earlier"))
    units = units.withColumn("lower", before([*per, "part"], "seg")).join(parts, [*per, "part"]).join(whole, per)
    units = units.select(*per, "seg", "all_held", "top_kept", F.coalesce("lower", "earlier").alias("lower"))
    final = ["rec", "id", "batch", "n_held", "change_id", "balance_cents", "op"]
    found = F.when(F.col("found"), version).otherwise(F.col("lower"))
    sales = out.where("rec = 'sale' and split").join(units, [*per, "seg"], "left").withColumn("v", F.when(F.col("sold") & (~found["kept"] | (found["seg"] == F.col("top_kept"))), found))
    sales = sales.select("rec", "id", "batch", F.coalesce("all_held", F.lit(0).cast("long")).alias("n_held"), "v.change_id", "v.balance_cents", "v.op")
    whole = out.where("rec = 'late' or rec = 'sale' and not split").select(*final).unionByName(sales)
    return whole.withColumn("batch", F.col("batch").cast("long"))


def enrich_sales(sales: DataFrame, changes: DataFrame, hot: int = HOT, unit: int = UNIT, bucket: int = BUCKET) -> DataFrame:
    """rec (`sale` or `late`), id, batch, and for sales n_held, change_id, balance_cents, op."""
    spark = sales.sparkSession
    base = written(_rows(sales, changes), "rows")
    n = base.count()
    if not n:
        return _resolved(spark.createDataFrame([], _OUT))
    buckets = n // bucket + 1
    marks = _watermarks(base)
    units, made = _units(base, hot, unit)
    units = units.withColumn("bucket", F.pmod(F.xxhash64("client", "known", "seg"), F.lit(buckets)))
    folder = new_path(spark, "enrich")
    units.unionByName(_clock(spark, marks, buckets)).write.partitionBy("batch").parquet(f"{folder}/dealt")
    for t in (base, made):
        drop(t)
    schema = spark.read.parquet(f"{folder}/dealt").drop("batch").schema
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{folder}/fed"))
    before = {k: spark.conf.get(k, None) for k in _STORE}
    try:
        for k, x in _STORE.items():
            spark.conf.set(k, x)
        for b in range(len(marks)):
            fs.rename(path(f"{folder}/dealt/batch={b}"), path(f"{folder}/fed/batch={b}"))
            stream = spark.readStream.schema(schema).parquet(f"{folder}/fed").drop("batch")
            done = stream.groupBy("bucket").transformWithStateInPandas(Enrich(), _OUT, "Append", "None")
            done.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    return _resolved(spark.read.schema(_OUT).parquet(f"{folder}/out"))
