"""MinHash near-dedup by chosen-path set similarity join.

Documents with equal shingle sets form one class. Every tree hashes the classes by randomly
chosen minhash coordinates: classes that agree on a coordinate share a node. Small nodes are
compared exhaustively on their signatures; of a large node every member is compared with one
random member. A node whose members are then all in one component is done; one with a few others
has these compared with all, in blocks. The rest branch by further coordinates, one or two of
them, so that a pair at the threshold is expected to stay together once per level, and what is
still mixed at the last level is compared in blocks too, so no pair is left out for the size of
its node. Independent trees raise the recall. Every link is confirmed on full sets: a few pairs
one by one, those of a crowd whose members are mostly alike where the crowd's sets meet, in
parts of bounded size, and of them only links that join something go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrain.llm.common import ASCII_LOWER, WORD, documents, mix, released, slices, texts_of, with_digest, word_hashes
from tillgrain.llm.components import components
from tillgrain.llm.repeats import BASES, rolling
from tillgrain.session import Scratch

SHINGLE = 5
PERCENT = 75
COORDINATES = 128
TREES = 16
LEVELS = 4
SMALL = 4096
#: pairs a member, beyond which the like members of a node are a crowd; members and bytes of sets in
#: half a part of a crowd
CROWD = 8
HALF_MEMBERS = 1000
HALF_BYTES = 4_000_000
#: signatures, 8 bits a coordinate, must agree on this share at least: 4 standard deviations below
#: what is expected at the threshold
ESTIMATE = 0.6

_random = np.random.default_rng(11)
FACTORS = _random.integers(0, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _random.integers(0, 2**32, COORDINATES, dtype=np.uint32)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` words, in order; of all words if there are fewer."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < size:
        whole = rolling(hashes, len(hashes), BASES[0]) + np.uint64(len(words))
        return mix(whole * BASES[1])
    return np.unique(mix(rolling(hashes, size, BASES[0])))


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over the set."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 2048):
        part = low[at : at + 2048]
        best = np.minimum(best, (FACTORS[:, None] * part + OFFSETS[:, None]).min(axis=1))
    return best


def brief(minima: np.ndarray) -> bytes:
    """8 bits a coordinate, remixed: the high bits of minima are alike in all large sets."""
    return ((minima * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, keys, signatures, briefs = [], [], [], []
        for text in texts_of(batch):
            found = shingles(text)
            sizes.append(len(found))
            keys.append(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64)) if len(found) else None)
            found = signature(found) if len(found) else None
            signatures.append(None if found is None else found.view(np.int32))
            briefs.append(None if found is None else brief(found))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("doc_id")),
                batch.column(batch.schema.get_field_index("text_key")),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.int64()),
                pa.array(signatures, pa.list_(pa.int32())),
                pa.array(briefs, pa.binary()),
            ],
            names=["doc_id", "text_key", "n_shingles", "set_key", "signature", "brief"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets, 48 bits a shingle: enough to compare two sets with each other."""
    for batch in slices(batches, 2_000_000):
        packed = []
        for text in texts_of(batch):
            found = shingles(text) >> np.uint64(16)
            packed.append(found.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("set_key")), pa.array(packed, pa.binary())],
            names=["set_key", "shingles"],
        )


def _unpacked(packed: bytes) -> np.ndarray:
    narrow = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :6] = narrow
    return wide.view(np.uint64).ravel()


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                left, right = _unpacked(x), _unpacked(y)
                both = len(np.intersect1d(left, right, assume_unique=True))
                found.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b", "la", "lb"]).filter(pa.array(found, pa.bool_()))

    return run


def agreement(matrix: np.ndarray, step: int = 256) -> np.ndarray:
    """How many coordinates the briefs of any two members have in common, the earlier one leading."""
    if len(matrix) <= 48:
        return (matrix[:, None, :] == matrix[None, :, :]).sum(axis=2, dtype=np.uint8)
    agree = np.zeros((len(matrix), len(matrix)), np.uint8)
    columns = np.ascontiguousarray(matrix.T)
    for at in range(0, len(matrix), step):
        for column in columns:
            agree[at : at + step, at:] += column[at : at + step, None] == column[None, at:]
    return agree


def parts(keys: list[int], sizes: list[int]) -> list[list[int]]:
    """Lists that bring together any two of the keys, each of two runs of bounded size."""
    runs, held = [[]], 0
    for key, size in sorted(zip(keys, sizes, strict=True)):
        if runs[-1] and (len(runs[-1]) == HALF_MEMBERS or held + 6 * size > HALF_BYTES):
            runs.append([])
            held = 0
        runs[-1].append(key)
        held += 6 * size
    if len(runs) == 1:
        return runs
    return [runs[i] + runs[j] for i in range(len(runs)) for j in range(i + 1, len(runs))]


PAIRS = "a bigint, b bigint, first boolean, members array<bigint>"


def _compare(estimate: float):
    """Similar pairs of small nodes; ``first`` marks those that span each node's groups.

    Of a crowd the like members are returned instead of their pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for members in batch.column(0).to_pylist():
                keys = [m["set_key"] for m in members]
                matrix = np.frombuffer(b"".join(m["brief"] for m in members), np.uint8).reshape(len(keys), -1)
                labels = np.array([m["label"] for m in members])
                agree = agreement(matrix)
                alike = np.triu(agree >= estimate * COORDINATES, 1)
                alike &= labels[:, None] != labels[None, :]
                at = np.flatnonzero(alike.any(axis=0) | alike.any(axis=1)).tolist()
                if np.count_nonzero(alike) > CROWD * len(at):
                    for part in parts([keys[i] for i in at], [members[i]["n_shingles"] for i in at]):
                        for column, value in zip(out, (None, None, None, part), strict=True):
                            column.append(value)
                    continue
                left, right = np.nonzero(alike)
                parent = list(range(len(keys)))
                for k in np.argsort(-agree[left, right].astype(np.int16), kind="stable"):
                    i, j = int(left[k]), int(right[k])
                    x, y = _root(parent, i), _root(parent, j)
                    parent[x] = y
                    for column, value in zip(out, (min(keys[i], keys[j]), max(keys[i], keys[j]), x != y, None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["a", "b", "first", "members"]
            )

    return run


def in_common(sets: list[np.ndarray], few: int = 12, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of any two sets, the earlier one leading, counted value by value.

    Holders of a value that ``few`` sets have at most are paired; other values are columns of a
    matrix, ``step`` of them at a time, that is multiplied with itself.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    owner, begins = owner[order], np.cumsum(held) - held
    both = np.zeros((len(sets), len(sets)), np.int32)
    for count in range(2, few + 1):
        holders = owner[begins[held == count][:, None] + np.arange(count)]
        for i in range(count):
            for j in range(i + 1, count):
                np.add.at(both, (holders[:, i], holders[:, j]), 1)
    common = np.flatnonzero(held > few)
    for at in range(0, len(common), step):
        columns = common[at : at + step]
        holds = np.zeros((len(sets), len(columns)), np.float32)
        rows = np.concatenate([owner[begins[c] : begins[c] + held[c]] for c in columns])
        holds[rows, np.repeat(np.arange(len(columns)), held[columns])] = 1
        both += (holds @ holds.T).astype(np.int32)
    return both


def _links(percent: int):
    """Of the links within a crowd, those that join labels not yet joined within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for members in batch.column(0):
                members = members.as_py()
                labels = [m["label"] for m in members]
                sets = [_unpacked(m["shingles"]) for m in members]
                sizes = np.array([len(s) for s in sets], np.int32)
                both = in_common(sets)
                linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
                index = {label: k for k, label in enumerate(dict.fromkeys(labels))}
                group = [index[label] for label in labels]
                parent = list(range(len(index)))
                for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1))), strict=True):
                    x, y = _root(parent, group[i]), _root(parent, group[j])
                    if x != y:
                        parent[x] = y
                        for column, value in zip(out, (members[i]["set_key"], members[j]["set_key"], labels[i], labels[j]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "la", "lb"])

    return run


def _alike(estimate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in (2, 3)
            )
            near = (left == right).mean(axis=1) >= estimate
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


class Join:
    """The state of one similarity join: classes and the labels that confirmed links give them."""

    def __init__(self, docs: DataFrame, scratch: Scratch, percent: int = PERCENT):
        self.scratch, self.percent = scratch, percent
        self.docs = docs
        self.rows = scratch.write(
            docs.select("doc_id", "text_key", "text").mapInArrow(
                released(_sketch),
                "doc_id bigint, text_key bigint, n_shingles bigint, set_key bigint, signature array<int>, brief binary",
            )
        )
        held = self.rows.filter("set_key is not null")
        first = held.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("at"))
        self.classes = scratch.write(
            held.join(first, "set_key")
            .filter(F.col("at.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("at.text_key") == F.col("text_key")))
            .select("set_key", "doc_id", "text_key", "n_shingles", "signature", "brief")
            .dropDuplicates(["set_key"])
        )
        none = "set_key bigint, label bigint"
        self.labels = scratch.spark.createDataFrame([], none)
        self.sets = None

    def nodes(self) -> DataFrame:
        """Level 1: (path, set_key) of every class in every tree."""
        rng = np.random.default_rng(5)
        chosen = []
        for tree in range(TREES):
            count = 1 + int(rng.random() < 100 / self.percent - 1)
            chosen += [(tree, int(c)) for c in rng.choice(COORDINATES, count, replace=False)]
        places = F.explode(
            F.array(*[F.xxhash64(F.lit(t), F.lit(c), F.element_at("signature", c + 1)) for t, c in chosen])
        )
        return self.classes.select("set_key", places.alias("path"))

    def branched(self, rows: DataFrame) -> DataFrame:
        """The next level of large nodes: one coordinate a node, or two with probability 1/t - 1."""
        more = F.pmod(F.xxhash64("path", F.lit(2)), F.lit(1000)) < int(1000 * (100 / self.percent - 1))
        coordinate = F.pmod(F.xxhash64("path", F.col("branch")), F.lit(COORDINATES)).cast("int")
        return (
            rows.withColumn("branch", F.explode(F.when(more, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .join(self.classes.select("set_key", "signature"), "set_key")
            .select("set_key", F.xxhash64("path", "branch", F.element_at("signature", coordinate + 1)).alias("path"))
        )

    def shared(self, rows: DataFrame) -> DataFrame:
        """Rows of nodes with two members at least, with the node's size and a random member."""
        counts = rows.groupBy("path").agg(
            F.count(F.lit(1)).alias("size"),
            F.min(F.struct(F.xxhash64("path", "set_key").alias("lot"), "set_key")).alias("pivot"),
        )
        counts = counts.filter("size > 1").select("path", "size", F.col("pivot.set_key").alias("pivot"))
        return self.scratch.write(rows.join(counts, "path"))

    def small_pairs(self, lists: DataFrame) -> DataFrame:
        """Pairs of like signatures within lists of set keys, labels apart, and crowds of them."""
        members = (
            lists.select(F.xxhash64("members").alias("node"), F.explode("members").alias("set_key"))
            .join(self.classes.select("set_key", "n_shingles", "brief"), "set_key")
            .join(self.labels, "set_key", "left")
            .groupBy("node")
            .agg(F.collect_list(F.struct("set_key", "n_shingles", "brief", F.coalesce("label", "set_key").alias("label"))).alias("members"))
        )
        found = members.select("members").mapInArrow(released(_compare(ESTIMATE)), PAIRS)
        return found.groupBy("a", "b", "members").agg(F.max("first").alias("first"))

    def crowded(self, crowds: DataFrame) -> DataFrame:
        """Links within crowds: a crowd's sets meet once, and its pairs are no rows."""
        sets = (
            crowds.select(F.xxhash64("members").alias("node"), F.explode("members").alias("set_key"))
            .join(self.sets, "set_key")
            .join(self.labels, "set_key", "left")
            .groupBy("node")
            .agg(F.collect_list(F.struct("set_key", F.coalesce("label", "set_key").alias("label"), "shingles")).alias("members"))
        )
        return sets.select("members").mapInArrow(released(_links(self.percent)), "a bigint, b bigint, la bigint, lb bigint")

    def confirm(self, pairs: DataFrame, crowds: DataFrame) -> None:
        """Confirm the pairs whose labels differ on full sets and merge the labels of links.

        Components are sought among labels only: what earlier links joined is one node.
        """
        left = self.labels.withColumnsRenamed({"set_key": "a", "label": "la"})
        right = self.labels.withColumnsRenamed({"set_key": "b", "label": "lb"})
        differ = self.scratch.write(
            pairs.select("a", "b")
            .distinct()
            .join(left, "a", "left")
            .join(right, "b", "left")
            .select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
            .filter("la != lb")
        )
        with_right = differ.join(self.sets.withColumnsRenamed({"set_key": "b", "shingles": "y"}), "b")
        full = with_right.join(self.sets.withColumnsRenamed({"set_key": "a", "shingles": "x"}), "a")
        linked = full.select("a", "b", "x", "y", "la", "lb").mapInArrow(released(_confirm(self.percent)), "a bigint, b bigint, la bigint, lb bigint")
        linked = self.scratch.write(linked.unionByName(self.crowded(crowds)))
        self.scratch.drop(differ)
        if linked.isEmpty():
            return
        merged = components(linked.select("la", "lb").distinct(), self.scratch, "la", "lb")
        ends = linked.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
        fresh = ends.join(self.labels, "set_key", "left_anti").select("set_key", F.col("set_key").alias("label"))
        named = self.labels.unionByName(fresh).join(merged.withColumnRenamed("node", "label"), "label", "left")
        self.labels = self.scratch.write(named.select("set_key", F.coalesce("component", "label").alias("label")))

    def fetch(self, keys: DataFrame) -> None:
        """Full sets of all classes that may be in a link; every later level is among them."""
        wanted = keys.distinct().join(self.classes.select("set_key", "doc_id", "text_key"), "set_key")
        found = (
            self.docs.join(wanted, ["doc_id", "text_key"])
            .select("set_key", "text")
            .mapInArrow(released(_sets), "set_key bigint, shingles binary")
        )
        self.sets = self.scratch.write(found.dropDuplicates(["set_key"]))

    def stars(self, large: DataFrame) -> DataFrame:
        """Pairs of a large node's random member with every other of a like signature."""
        briefs = self.classes.select("set_key", "brief")
        centres = (
            large.select("path", F.col("pivot").alias("set_key")).distinct()
            .join(briefs, "set_key").select("path", F.col("brief").alias("centre"))
        )
        pairs = large.filter("set_key != pivot").join(briefs, "set_key").join(centres, "path").select(
            F.least("set_key", "pivot").alias("a"), F.greatest("set_key", "pivot").alias("b"), "brief", "centre"
        )
        return pairs.mapInArrow(released(_alike(ESTIMATE)), "a bigint, b bigint")

    def labelled(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.labels, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))

    def blocks(self, rows: DataFrame) -> DataFrame:
        """Lists that bring together any two members of a node with different labels.

        All members are dealt into blocks, those without the node's most frequent label into
        chunks as well, and each list is a block and a chunk of half of ``SMALL`` members each.
        """
        half = SMALL // 2
        named = self.labelled(rows)
        counts = named.groupBy("path", "label").agg(F.count(F.lit(1)).alias("n"))
        most = counts.groupBy("path").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
        dealt = named.join(most, "path").select(
            "path",
            "set_key",
            (F.col("label") != F.col("most.label")).alias("other"),
            F.ceil(F.col("all") / half).cast("int").alias("blocks"),
            F.ceil((F.col("all") - F.col("most.n")) / half).cast("int").alias("chunks"),
        )
        spread = F.xxhash64("set_key", F.lit(3))
        i, j = F.pmod(spread, "blocks").cast("int"), F.pmod(spread, "chunks").cast("int")
        members = dealt.select("path", "set_key", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
        others = dealt.filter("other").select(
            "path", "set_key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), j.alias("j")
        )
        both = members.unionByName(others).groupBy("path", "i", "j")
        return both.agg(F.sort_array(F.collect_set("set_key")).alias("members"))

    def mixed(self, large: DataFrame) -> DataFrame:
        """Rows of nodes with more than one label, with the number of members outside the largest."""
        counts = self.labelled(large).groupBy("path", "label").agg(F.count(F.lit(1)).alias("n"))
        others = counts.groupBy("path").agg((F.sum("n") - F.max("n")).alias("others")).filter("others > 0")
        return large.join(others, "path")

    def run(self) -> None:
        rows = self.nodes()
        for level in range(1, LEVELS + 1):
            rows = self.shared(rows)
            lists = (
                rows.filter(F.col("size") <= SMALL)
                .groupBy("path")
                .agg(F.sort_array(F.collect_list("set_key")).alias("members"))
                .select("members")
                .distinct()
            )
            found = self.scratch.write(self.small_pairs(lists))
            pairs, crowds = found.filter("members is null"), found.filter("members is not null").select("members")
            large = rows.filter(F.col("size") > SMALL)
            if level == 1:
                ends = found.select(F.explode(F.coalesce("members", F.array("a", "b"))).alias("set_key"))
                self.fetch(ends.unionByName(large.select("set_key")))
            self.confirm(pairs.filter("first").select("a", "b").unionByName(self.stars(large)), crowds)
            left, others = self.scratch.write(self.mixed(large)), pairs.filter("not first").select("a", "b")
            if left.isEmpty():
                self.confirm(others, crowds.limit(0))
                return
            done = F.lit(level == LEVELS) | (F.col("others") <= SMALL)
            ended = self.scratch.write(self.small_pairs(self.blocks(left.filter(done)).select("members").distinct()))
            self.confirm(
                others.unionByName(ended.filter("members is null").select("a", "b")),
                ended.filter("members is not null").select("members"),
            )
            rest = self.scratch.write(self.mixed(left.filter(~done).drop("others")).select("path", "set_key"))
            self.scratch.drop(rows, found, left, ended)
            rows = rest
            if rows.isEmpty():
                return
            rows = self.branched(rows)

    def result(self) -> DataFrame:
        """doc_id, text_key, n_shingles, label of the component and component_id per row."""
        named = self.rows.select("doc_id", "text_key", "n_shingles", "set_key").join(self.labels, "set_key", "left")
        named = named.withColumn("label", F.coalesce("label", "set_key"))
        smallest = named.filter("set_key is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
        return named.join(smallest, "label", "left").select(
            "doc_id", "text_key", "n_shingles", "label", F.coalesce("least", "doc_id").alias("component_id")
        )


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, label, component_id and kept per document.

    Documents without words are linked with nothing. Rows that share a doc_id are documents of
    their own; of a component the rows with the smallest doc_id are kept. A component of rows
    without doc_id has none. Only doc_id and text are read.
    """
    keyed = with_digest(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    join = Join(keyed, scratch, percent)
    join.run()
    return join.result().withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents, one of each component, with all their columns.

    Of a component the row with the smallest (doc_id, text key) stays, null doc_ids last; where
    rows repeat both, one of them stays. Documents without words all stay.
    """
    found = near_duplicates(docs, scratch)
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    group = F.coalesce("label", "text_key")
    heads = found.filter("n_shingles > 0").groupBy(group.alias("label")).agg(
        F.min(key).alias("head"), F.count(F.lit(1)).alias("size")
    )
    kept = heads.select("head.doc_id", "head.text_key", (F.col("size") > 1).alias("shared")).alias("k")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("worded"),
    ).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_key") == F.col("k.text_key"))
    held = rows.filter("worded").join(kept, same).select("row", "d.doc_id", "d.text_key", "shared")
    once = held.filter("shared").dropDuplicates(["doc_id", "text_key"]).select("row.*")
    return (
        held.filter(~F.col("shared")).select("row.*").unionByName(once)
        .unionByName(rows.filter(~F.col("worded")).select("row.*"))
    )


def op8_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(documents(spark, folder), Scratch(spark))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
