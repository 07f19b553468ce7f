"""Short codes for vectors: a codebook for each part of the vectors, fitted by Lloyd rounds whose members stay where their entry lives."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postprism.operators.lookup import lookup_join
from postprism.session import materialise

PARTS = 16  # equal consecutive parts of a vector
ENTRIES = 64  # of each part's codebook
ROUNDS = 2
SCALE = 256  # components become whole numbers of this fraction
LARGEST = 1 << 26  # scaled components end here, so that squared distances stay exact
MEMBERS = 1 << 16  # most members of an owner
_AT_ONCE = 8_192  # parts whose distances are held at a time


def whole_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(row, key, label, vector)``: the usable rows, numbered, with components ``floor(SCALE * x)``.

    Left out are vectors that are NULL or hold a NULL or non-finite component, and those that cannot be cut alike: the length is that of
    the smallest key among vectors of a positive multiple of PARTS components; a NULL key comes last. Scaled components beyond LARGEST end there.
    """
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = table.where(F.col(vector).isNotNull() & sound & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0))
    scaled = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    rows = usable.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), scaled.alias("vector"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    first = rows.select("key", F.size("vector").alias("length")).orderBy(F.col("key").asc_nulls_last(), "length").first()
    return rows.where(F.size("vector") == (first["length"] if first else 0))


def fit(rows: DataFrame) -> np.ndarray:
    """Codebooks of the vectors of :func:`whole_vectors`: (part, entry, component).

    They start as the parts of the ENTRIES smallest keys (equal keys by their vectors). In each round every part goes to its nearest entry
    and each entry becomes the floored mean of its members; an entry without members stays.

    Members live with their entry: rows are dealt by (position, entry, salt) once. An owner sums its own members, so an
    update moves one row of sums per task and entry. After an update each owner compares its members with the new entries;
    those that stay are read where they lie, and only those that change entry are shuffled. Each entry has as many
    salts as its members need, so an entry with a third of all members is many owners. What reaches the driver is one row per entry.
    """
    seeds = [row["vector"] for row in rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(ENTRIES).collect()]
    if not seeds:
        return np.zeros((PARTS, 0, 0), dtype=np.int64)
    books = np.array(seeds, dtype=np.int64).reshape(len(seeds), PARTS, -1).transpose(1, 0, 2)
    parts = [f"x{i}" for i in range(books.shape[2])]
    places = ", ".join(f"{name} int" for name in parts)
    placed = rows.select("row", "vector").mapInArrow(_place(books), f"row long, position int, entry int, {places}")
    most = max(1, min(MEMBERS, -(-rows.count() // ENTRIES)))
    residents = _dealt(materialise(placed, "placed"), most)
    for turn in range(ROUNDS):
        books = _updated(books, residents, parts)
        if turn == ROUNDS - 1:
            return books
        compared = residents.select("row", "position", "entry", *parts).mapInArrow(
            _compare(books), f"row long, position int, entry int, next int, {places}"
        )
        compared = materialise(compared, "compared")
        moving = compared.where("next <> entry").select("row", "position", F.col("next").alias("entry"), *parts)
        residents = compared.where("next = entry").select("row", "position", "entry", *parts).union(_dealt(moving, most))
    return books


def _dealt(members: DataFrame, most: int) -> DataFrame:
    """Members with their owners, each of about ``most`` members at most."""
    counts = members.groupBy("position", "entry").agg(F.count(F.lit(1)).alias("_members"))
    owners = counts.select("position", "entry", F.ceil(F.col("_members") / most).alias("_owners"))  # PARTS * ENTRIES rows at most
    salted = members.join(F.broadcast(owners), ["position", "entry"]).withColumn("_salt", F.pmod(F.xxhash64("row"), "_owners"))
    return materialise(salted.repartition("position", "entry", "_salt").drop("_salt", "_owners").select(*members.columns), "owners")


def _updated(books: np.ndarray, residents: DataFrame, parts: list[str]) -> np.ndarray:
    sums = residents.groupBy("position", "entry").agg(F.count(F.lit(1)).alias("members"), *[F.sum(name).alias(name) for name in parts])
    books = books.copy()
    for row in sums.collect():  # PARTS * ENTRIES rows at most
        books[row["position"], row["entry"]] = [row[name] // row["members"] for name in parts]
    return books


def _nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, the first of equally near ones, and the squared distance."""
    index, least = np.empty(len(points), dtype=np.int32), np.empty(len(points), dtype=np.int64)
    for low in range(0, len(points), _AT_ONCE):
        some = points[low : low + _AT_ONCE].astype(np.int64)
        apart = np.zeros((len(some), len(entries)), dtype=np.int64)
        for j in range(entries.shape[1]):
            step = some[:, j, None] - entries[None, :, j]
            apart += step * step
        index[low : low + _AT_ONCE] = apart.argmin(axis=1)
        least[low : low + _AT_ONCE] = apart.min(axis=1)
    return index, least


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), PARTS, width)


def _place(books: np.ndarray):
    """Each vector as PARTS rows with their nearest entries."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(1), books.shape[2])
            for position in range(PARTS):
                own = points[:, position]
                entry, _ = _nearest(own, books[position])
                columns = [batch.column(0), pa.array(np.full(len(own), position, dtype=np.int32)), pa.array(entry)]
                columns += [pa.array(np.ascontiguousarray(own[:, j], dtype=np.int32)) for j in range(own.shape[1])]
                yield pa.record_batch(columns, names=["row", "position", "entry", *[f"x{j}" for j in range(own.shape[1])]])

    return of


def _compare(books: np.ndarray):
    """Members with the entry that is nearest now."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column(1).to_numpy()
            points = np.stack([batch.column(3 + j).to_numpy() for j in range(books.shape[2])], axis=1)
            following = np.empty(len(position), dtype=np.int32)
            for one in np.unique(position):
                own = position == one
                following[own], _ = _nearest(points[own], books[one])
            columns = [*batch.columns[:3], pa.array(following), *batch.columns[3:]]
            yield pa.record_batch(columns, names=["row", "position", "entry", "next", *batch.schema.names[3:]])

    return of


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with ``entries`` (one byte a part) and ``error``, the squared distances to the entries; nothing is shuffled."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(2), books.shape[2])
            entries = np.empty((len(points), PARTS), dtype=np.uint8)
            error = np.zeros(len(points), dtype=np.int64)
            for position in range(PARTS):
                entries[:, position], apart = _nearest(points[:, position], books[position])
                error += apart
            codes = pa.array([one.tobytes() for one in entries], type=pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), codes, pa.array(error)], names=["key", "label", "entries", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("key", "label", "vector").mapInArrow(of, f"key long, label {kind}, entries binary, error long")


def decode(entries: Column, books: np.ndarray) -> Column:
    """The vector that a code stands for: its entries one after another, scaled back."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in book]) for book in books])
    code = lambda at: F.conv(F.substring(F.hex(entries), 2 * at + 1, 2), 16, 10).cast("int")
    chosen = F.flatten(F.array(*[F.get(F.get(table, F.lit(at)), code(at)) for at in range(PARTS)]))
    return F.transform(chosen, lambda x: x / SCALE)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``(key, label, entries, error, label_error)`` of each usable vector, and the codebooks.

    ``label_error`` is the error summed over equal labels, NULLs together; a label on a third of all rows is no one task's work.
    Repeated rows are vectors each; no usable vector gives no rows.
    """
    rows = whole_vectors(table, key, vector, label)
    books = fit(rows)
    coded = materialise(encode(rows, books), "vector-codes")
    named = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = named.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return lookup_join(named, sums, "_label").select(F.col("key").alias(key), "label", "entries", "error", "label_error"), books
