"""Insert or overwrite product embeddings, the last update of an id winning."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shelfwise.functions.vectors import has_bad_element
from shelfwise.schemas import PRODUCT_EMBEDDINGS
from shelfwise.session import materialize, parallelism
from shelfwise.sources import files


def check_updates(updates: DataFrame, length: int | None = None) -> None:
    """Refuse the whole batch for one bad row: no id or vector, an element that is no finite number, or a vector of
    another length than the target's (``length``) or than the batch's others; or if a ``seq`` repeats within an id."""
    vector = F.col("image_vector")
    size = F.size(vector)
    wanted = F.lit(length) if length is not None else F.min(size)
    seen = updates.agg(
        F.count_if(F.col("id").isNull()).alias("no_id"), F.min(F.when(vector.isNull(), F.col("id"))).alias("no_vector"),
        F.min(F.when(has_bad_element(vector), F.col("id"))).alias("bad"),
        F.min(size).alias("shortest"), F.max(size).alias("longest"), wanted.alias("wanted"),
    ).first()
    if seen["no_id"]:
        raise ValueError("an update has no id")
    if seen["no_vector"] is not None:
        raise ValueError(f"product {seen['no_vector']} has no vector")
    if seen["bad"] is not None:
        raise ValueError(f"the vector of product {seen['bad']} has a non-numeric element")
    if seen["shortest"] is not None and not seen["shortest"] == seen["longest"] == seen["wanted"]:
        raise ValueError(f"vectors have {seen['shortest']} to {seen['longest']} elements, not {seen['wanted']}")
    twice = updates.groupBy("id", "seq").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"product {twice['id']} has seq {twice['seq']} more than once")


def last_updates(updates: DataFrame) -> DataFrame:
    """One row per id, the one with the highest ``seq``.

    The rank limit is applied before the shuffle too, so an id with very many updates sends one row per task.
    """
    latest = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return updates.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn", "seq")


def _checked(target: DataFrame, updates: DataFrame) -> DataFrame:
    """The winning updates of a good batch, stored; the batch itself is stored first and read from there."""
    names = PRODUCT_EMBEDDINGS.names
    batch = materialize(updates.select(*names, "seq"), "batch")
    row = target.where(F.col("image_vector").isNotNull()).select(F.size("image_vector").alias("n")).first()
    check_updates(batch, row["n"] if row else None)
    return materialize(last_updates(batch), "updates")


def upsert_embeddings(target: DataFrame, updates: DataFrame) -> DataFrame:
    """The table after the upsert, to be written as a new version.

    ``updates`` has the target's columns and ``seq``, its order in the batch, unique per id. An update
    replaces status, both categories and vector. Nothing is returned, and so nothing can be written, if
    the batch holds a bad row. The winning updates are stored once and read on both sides of the result.
    """
    names = PRODUCT_EMBEDDINGS.names
    new = _checked(target, updates)
    return target.select(*names).join(new, "id", "left_anti").unionByName(new.select(*names))


# --- A stored table in versions ---------------------------------------------------------------------------

# Bytes that one folder and one written file are meant to hold, and delta layers that readers merge at most.
FOLDER_BYTES = 1 << 30
FILE_BYTES = 128 << 20
MOST_DELTAS = 8


@dataclass(frozen=True)
class Layer:
    """Files of one write: for which folders they hold, and whether they replace rows by id (``delta``) or are the base."""

    files: str
    buckets: list[int]
    delta: bool


@dataclass(frozen=True)
class Version:
    """What a reader needs to know: the number of folders and the layers, oldest first."""

    number: int
    buckets: int
    layers: list[Layer]


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name[1:-5]) for name in files.names(spark, f"{path}/versions") if name.endswith(".json"))


def _load(spark: SparkSession, path: str, number: int) -> Version:
    raw = json.loads(files.read_text(spark, f"{path}/versions/v{number:010d}.json"))
    return Version(number, raw["buckets"], [Layer(**layer) for layer in raw["layers"]])


def current_version(spark: SparkSession, path: str) -> Version | None:
    """The newest complete version; one whose writer died over its manifest is passed over."""
    for number in reversed(_versions(spark, path)):
        try:
            return _load(spark, path, number)
        except json.JSONDecodeError:
            continue
    return None


def _commit(spark: SparkSession, path: str, after: int, buckets: int, layers: list[Layer]) -> Version:
    """Makes the layers the next version in one step: a small file that must not be there yet.

    ``after`` is the highest number seen before anything was read; of two writers that saw the same, one fails here and
    its files stay unseen.
    """
    version = Version(after + 1, buckets, layers)
    text = json.dumps({"buckets": buckets, "layers": [asdict(layer) for layer in layers]})
    if not files.create_text(spark, f"{path}/versions/v{version.number:010d}.json", text):
        raise RuntimeError(f"another writer has made version {version.number} of {path}; start again from it")
    return version


def _seen(spark: SparkSession, path: str) -> int:
    return max(_versions(spark, path), default=0)


def _write_layer(rows: DataFrame, path: str, buckets: int, delta: bool) -> Layer:
    """Write rows into folders by the hash of the id, each folder by as many tasks as its share of the bytes asks for."""
    name = f"files/{uuid.uuid4().hex}"
    sized = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("image_vector")).alias("dim")).first()
    n_bytes = sized["n"] * (4 * max(sized["dim"] or 0, 0) + 64)
    per_folder = max(1, -(-n_bytes // (buckets * FILE_BYTES)))
    # As many tasks as there are files; the writer orders a task's rows by folder, so each keeps one file open.
    tasks = max(1, min(buckets * per_folder, max(parallelism(rows.sparkSession), n_bytes // FILE_BYTES)))
    salt = F.pmod(F.xxhash64("id", F.lit("file")), F.lit(per_folder))
    placed = rows.select(*PRODUCT_EMBEDDINGS.names, F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"))
    placed.repartition(tasks, "bucket", salt).write.partitionBy("bucket").parquet(f"{path}/{name}")
    held = sorted(int(f.split("=")[1]) for f in files.names(rows.sparkSession, f"{path}/{name}") if f.startswith("bucket="))
    return Layer(name, held, delta)


def folders_for(rows: DataFrame) -> int:
    """Folders for a table by its counted bytes."""
    sized = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("image_vector")).alias("dim")).first()
    return max(1, -(-sized["n"] * (4 * max(sized["dim"] or 0, 0) + 64) // FOLDER_BYTES))


def write_embeddings(embeddings: DataFrame, path: str) -> Version:
    """Store a whole table as a new version, in folders by the hash of the id; their number follows its bytes."""
    spark = embeddings.sparkSession
    after = _seen(spark, path)
    buckets = folders_for(embeddings)
    layer = _write_layer(embeddings, path, buckets, delta=False)
    return _commit(spark, path, after, buckets, [layer] if layer.buckets else [])


def _read_layers(spark: SparkSession, path: str, version: Version, only: list[int] | None = None) -> DataFrame:
    names = PRODUCT_EMBEDDINGS.names
    schema = StructType([*PRODUCT_EMBEDDINGS.fields, StructField("bucket", IntegerType())])
    parts: dict[bool, list[DataFrame]] = {True: [], False: []}
    for i, layer in enumerate(version.layers):
        wanted = layer.buckets if only is None else sorted(set(layer.buckets) & set(only))
        if not wanted:
            continue
        rows = spark.read.schema(schema).parquet(f"{path}/{layer.files}")
        held = len(layer.buckets) == version.buckets and only is None
        rows = rows if held else rows.where(F.col("bucket").isin(wanted))
        parts[layer.delta].append(rows.select(*names, F.lit(i).alias("_layer")))
    empty = spark.createDataFrame([], PRODUCT_EMBEDDINGS)
    base = reduce(DataFrame.unionByName, parts[False]).drop("_layer") if parts[False] else empty
    if not parts[True]:
        return base
    deltas = reduce(DataFrame.unionByName, parts[True])
    if len(parts[True]) > 1:
        deltas = last_updates(deltas.withColumnRenamed("_layer", "seq"))
    else:
        deltas = deltas.drop("_layer")
    return base.join(deltas.select("id"), "id", "left_anti").unionByName(deltas.select(*names))


def read_embeddings(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of ``version``, the newest complete one unless given. Rows of delta layers replace those below."""
    found = current_version(spark, path) if version is None else _load(spark, path, version)
    if found is None:
        raise ValueError(f"no table is stored at {path}")
    return _read_layers(spark, path, found)


def upsert_stored(spark: SparkSession, path: str, updates: DataFrame) -> list[int]:
    """Upsert into a table stored by ``write_embeddings``; returns the folders that take new rows.

    The batch becomes one delta layer, written by many tasks and seen by readers in one step; no file of an earlier
    version is touched, so readers of it go on and a failed writer leaves it as it was. Where a table has more than
    ``MOST_DELTAS`` such layers they are merged into the folders concerned, see ``compact_stored``.
    """
    after = _seen(spark, path)
    old = current_version(spark, path)
    if old is None:
        raise ValueError(f"no table is stored at {path}")
    new = _checked(_read_layers(spark, path, old), updates)
    layer = _write_layer(new, path, old.buckets, delta=True)
    if not layer.buckets:
        return []
    made = _commit(spark, path, after, old.buckets, [*old.layers, layer])
    if sum(x.delta for x in made.layers) > MOST_DELTAS:
        compact_stored(spark, path)
    return layer.buckets


def compact_stored(spark: SparkSession, path: str) -> Version:
    """A version without delta layers. Folders that have deltas are written anew; the others keep their files.

    A table that has outgrown its folders twofold is written anew as a whole, in as many as its bytes ask for.
    """
    after = _seen(spark, path)
    old = current_version(spark, path)
    if old is None:
        raise ValueError(f"no table is stored at {path}")
    changed = sorted({b for layer in old.layers if layer.delta for b in layer.buckets})
    if not changed:
        return old
    whole = _read_layers(spark, path, old)
    buckets = folders_for(whole)
    if buckets >= 2 * old.buckets:
        return _commit(spark, path, after, buckets, [_write_layer(whole, path, buckets, delta=False)])
    fresh = _write_layer(_read_layers(spark, path, old, changed), path, old.buckets, delta=False)
    kept = [Layer(x.files, sorted(set(x.buckets) - set(changed)), False) for x in old.layers if not x.delta]
    return _commit(spark, path, after, old.buckets, [*[x for x in kept if x.buckets], fresh])


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions and the files that none of those refers to; returns how many."""
    numbers = _versions(spark, path)
    if keep < 1 or current_version(spark, path) is None:
        raise ValueError("at least one complete version is kept")
    complete = []
    for number in numbers:
        try:
            complete.append(_load(spark, path, number))
        except json.JSONDecodeError:
            continue
    kept, used = complete[-keep:], {layer.files for v in complete[-keep:] for layer in v.layers}
    gone = [v for v in complete if v not in kept]
    for v in gone:
        files.delete(spark, f"{path}/versions/v{v.number:010d}.json")
    for name in {layer.files for v in gone for layer in v.layers} - used:
        files.delete(spark, f"{path}/{name}")
    return len(gone)
