"""Embedding near-duplicates: int8 tile products with error bounds, exact cosines where they matter.

Equal vectors of a label merge into one class first. The classes of a label are dealt into blocks
of bounded size, and each pair of blocks is one tile, worked on by one task. A vector is stored as
int8 codes times a scale plus a rest of known length, so the product of two coded vectors differs
from their cosine by no more than the lengths say. A tile multiplies codes, adds the bound, and
computes in double precision only the pairs that may reach the threshold. It returns a row per
class at most: its links in the tile and the head of its component there, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm.components import components
from tillgrain.session import Scratch

THRESHOLD = 0.93
#: vectors in a block at most, and bytes of them
TILE, TILE_BYTES = 8192, 32 * 2**20
#: rows of a block multiplied at once; numbers held while cosines are computed
STRIP, EXACT = 512, 4_000_000

BLOCK = "label string, dims int, block int, blocks int, classes binary, copies binary, vectors binary, codes binary, scales binary, rests binary"
LINKED = "class bigint, links bigint, head bigint"


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scale and length of the rest of each unit vector."""
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scales = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scales[:, None]).astype(np.int8)
    rests = np.linalg.norm(unit - codes * scales[:, None], axis=1)
    return codes, scales, rests + 1e-12


def bounded(codes: np.ndarray, scales: np.ndarray, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right factors whose product is at least the cosine, but for ``slack``.

    With u = q + e and v = r + f: u.v <= q.r + |q||f| + |e|(|r| + |f|); two further columns add the
    bound within the product.
    """
    plain = codes.astype(np.float64) * scales[:, None]
    sizes = np.linalg.norm(plain, axis=1)
    left = np.column_stack((plain, sizes, rests))
    right = np.column_stack((plain, rests, sizes + rests))
    return left.astype(np.float32), right.astype(np.float32)


def slack(dims: int) -> float:
    """What rounding to single precision can take from such a product."""
    return (dims + 8) * 2.0**-22


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Doubles with a largest component of one, so that no square overflows or vanishes."""
    vectors = vectors.astype(np.float64)
    return vectors / np.abs(vectors).max(axis=1)[:, None]


def _pack(table: pa.Table) -> pa.Table:
    """One block of classes as one row."""
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(table.num_rows, -1)
    codes, scales, rests = quantise(scaled(vectors))
    arrays = (table.column("class").to_numpy(), table.column("copies").to_numpy(), vectors, codes, scales, rests)
    first = {c: table.column(c).slice(0, 1) for c in ("label", "dims", "block", "blocks")}
    names = ("classes", "copies", "vectors", "codes", "scales", "rests")
    return pa.table(first | {n: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for n, x in zip(names, arrays, strict=True)})


class _Block:
    def __init__(self, row: dict, real: np.dtype):
        dims = row["dims"]
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.classes, self.copies = read("classes", np.int64), read("copies", np.int64)
        self.vectors = scaled(read("vectors", real).reshape(-1, dims))
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.left, self.right = bounded(read("codes", np.int8).reshape(-1, dims), read("scales", np.float64), read("rests", np.float64))


def merge(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of nodes after joining the ends of edges; a root is its tree's smallest node."""
    while True:
        x, y = roots[a], roots[b]
        apart = x != y
        if not apart.any():
            return roots
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while (roots[roots] != roots).any():
            roots = roots[roots]


def tile(real: np.dtype, threshold: float):
    """Links between the classes of two blocks, or of one with itself."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        left = _Block(rows[0], real)
        same = rows[0]["i"] == rows[0]["j"]
        right = left if same else _Block(rows[1], real)
        dims, offset = left.vectors.shape[1], 0 if same else len(left.classes)
        total = offset + len(right.classes)
        classes = left.classes if same else np.concatenate((left.classes, right.classes))
        copies = left.copies if same else np.concatenate((left.copies, right.copies))
        links, roots = np.zeros(total, np.int64), np.arange(total)
        least, part = threshold - slack(dims), max(1, EXACT // dims)
        for low in range(0, len(left.classes), STRIP):
            a, b = np.nonzero(left.left[low : low + STRIP] @ right.right.T >= least)
            a = a + low
            if same:
                a, b = a[a < b], b[a < b]
            for at in range(0, len(a), part):
                x, y = a[at : at + part], b[at : at + part]
                cosine = np.einsum("ij,ij->i", left.vectors[x], right.vectors[y]) / (left.norms[x] * right.norms[y])
                near = cosine >= threshold
                x, y = x[near], y[near] + offset
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                roots = merge(roots, x, y)
        held = np.flatnonzero(links)
        return pa.table({"class": classes[held], "links": links[held], "head": classes[roots[held]]})

    return run


def _valid(column: str):
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(column, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, tile_rows: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for rows (vec_id, embedding, label).

    Rows are compared when their labels are equal and not null and their vectors equally long.
    Null, empty and zero vectors and such with null or non-finite components link with nothing and
    stay. Every row counts as a vector, also one that repeats an id or a whole row. A row without
    vec_id links like any other, is never the smallest of a component and never kept. Other
    columns are not read; an empty table gives an empty result.
    """
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    real = np.dtype(np.float64 if kind == "double" else np.float32)
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>" if kind == "double" else "array<float>").alias("embedding"),
        F.col("label").cast("string").alias("label"),
    )
    usable = rows.filter(F.col("label").isNotNull() & _valid("embedding"))
    grouped = usable.groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    # the numbers hold once they are written
    classes = scratch.write(grouped.withColumn("dims", F.size("embedding")).withColumn("class", F.monotonically_increasing_id()))
    most = F.greatest(F.lit(1), F.least(F.lit(tile_rows), F.floor(F.lit(TILE_BYTES) / (F.col("dims") * 9)).cast("int")))
    blocks = classes.groupBy("label", "dims").agg(F.count("*").alias("held")).withColumn("blocks", F.ceil(F.col("held") / most).cast("int"))
    dealt = classes.join(blocks, ["label", "dims"]).withColumn("block", F.expr("cast(pmod(xxhash64(class), blocks) as int)"))
    packed = scratch.write(
        dealt.select("label", "dims", "block", "blocks", "class", "copies", "embedding").groupBy("label", "dims", "block").applyInArrow(_pack, BLOCK)
    )
    # a block meets itself and each other block of its label once
    met = packed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with")).drop("with")
    found = cells.groupBy("label", "dims", "i", "j").applyInArrow(_whole(tile(real, threshold)), LINKED)
    linked = scratch.write(found)
    links = linked.groupBy("class").agg(F.sum("links").alias("links"))
    edges = linked.filter(F.col("class") != F.col("head")).select(F.col("class").alias("a"), F.col("head").alias("b")).distinct()
    named = components(edges, scratch).select(F.col("node").alias("class"), "component")
    joined = scratch.write(
        classes.select("label", "embedding", "class", "copies", "least")
        .join(links, "class", "left")
        .join(named, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    known = joined.join(least, "component").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    done = rows.join(known, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _whole(run):
    """A tile whose second block is empty has no links of its own."""

    def check(table: pa.Table) -> pa.Table:
        if table.num_rows == 1 and table.column("i")[0].as_py() != table.column("j")[0].as_py():
            return pa.table({c: pa.array([], pa.int64()) for c in ("class", "links", "head")})
        return run(table)

    return check


def op11_int8_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings; see ``near_vectors``."""
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"), Scratch(spark))


OP11_SQL = f"""
WITH RECURSIVE numbered AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
  SELECT * FROM numbered
  WHERE label IS NOT NULL AND e IS NOT NULL
    AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(e, lambda x: x <> 0))
), links AS (
  SELECT a.r AS x, b.r AS y FROM usable a JOIN usable b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach AS (
  SELECT r, r AS s FROM numbered UNION SELECT reach.r, links.y FROM reach JOIN links ON reach.s = links.x
), named AS (
  SELECT reach.r, min(numbered.vec_id) AS component_id FROM reach JOIN numbered ON numbered.r = reach.s GROUP BY reach.r
), counted AS (
  SELECT x AS r, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, FALSE) AS kept
FROM numbered JOIN named USING (r) LEFT JOIN counted USING (r)
"""
