"""Near duplicates: universal hash minima, banding, verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchfire.llm.common import materialise, slices, unused
from watchfire.llm.components import components
from watchfire.llm.wordhash import WordHashes, shingle_set

#: Documents and shingles that one task compares with each other at most.
BLOCK_DOCS, BLOCK_SHINGLES = 4000, 3_000_000
#: A signature refutes a link if it agrees in so much less than the least similarity. Agreement is binomial, so a link
#: of exactly 0.85 is refuted by 112 minima about once in 10 ** 9 times, one of 0.8 once in 10 ** 8.
SLACK = 0.22
_HASHES = WordHashes()


def family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n universal hash functions x -> a * x + b (mod 2 ** 32), a odd."""
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a document's shingles (not empty)."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024]
        h = a[:, None] * part[None, :]
        h += b[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def _set(text: str | None, n: int) -> np.ndarray:
    """Shingles of the text with A-Z lower-cased."""
    return shingle_set(_HASHES.of(text.encode().lower().split()) if text else np.empty(0, np.uint64), n)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def least_agreement(hashes: int, percent: int) -> int:
    """Equal minima below which two signatures refute a link."""
    return max(1, int(hashes * (percent / 100 - SLACK)))


class _Forest:
    def __init__(self, start: np.ndarray):
        """start: a number for each document; equal numbers are one tree from the beginning."""
        _, self.tree = np.unique(start, return_inverse=True)

    def merge(self, i: int, j: int) -> None:
        a, b = self.tree[i], self.tree[j]
        self.tree[self.tree == max(a, b)] = min(a, b)


def _cluster(
    sets: list[np.ndarray], signatures: np.ndarray, forest: _Forest, rows: np.ndarray, columns: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Links found between rows and columns (positions) until every two that are linked are in one tree.

    A pair is compared in full if its trees differ and its signatures do not refute the link: so a document of a large
    group needs one comparison, not one with each of the group.
    """
    links = []
    n_hashes = signatures.shape[1]
    least = least_agreement(n_hashes, percent)
    sizes = np.array([len(s) for s in sets])
    for i in rows:
        others = columns[forest.tree[columns] != forest.tree[i]]
        if not len(others):
            continue
        fits = (100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])) & (sizes[others] > 0)
        others = others[fits]
        if not len(others) or not sizes[i]:
            continue
        agree = (signatures[others] == signatures[i]).sum(axis=1)
        order = np.argsort(-agree, kind="stable")
        others = others[order[agree[order] >= least]]
        while len(others):
            j = others[0]
            if linked(sets[i], sets[j], percent):
                links.append((int(i), int(j)))
                forest.merge(i, j)
                others = others[1:][forest.tree[others[1:]] != forest.tree[i]]
            else:
                others = others[1:]
    return links


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, size of the shingle set, 128-bit fingerprint of the set (two longs), a key for each band of the signature,
    and the low byte of each minimum."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()),
            ("keys", pa.list_(pa.int64())), ("short", pa.binary()),
        ]
    )
    width = 4 * rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = family(bands * rows)
        for batch in slices(batches):
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                s = _set(text, n)
                hi = lo = keys = short = None
                if len(s):
                    hi, lo = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                    sig = signature(s, a, b)
                    raw = sig.tobytes()
                    keys = np.frombuffer(b"".join(xxhash.xxh3_64_digest(raw[i * width : (i + 1) * width], i) for i in range(bands)), np.int64)
                    short = (sig & np.uint32(255)).astype(np.uint8).tobytes()
                for column, value in zip(out, (doc, len(s), hi, lo, keys, short)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.mapInArrow(measure, "doc_id long, n_shingles long, set_hi long, set_lo long, keys array<long>, short binary")


def _agreeing(ids: np.ndarray, signatures: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges that connect whatever pairs of agreeing signatures connect. Each document is compared only with those that
    none before has reached, so a group of alike ones costs one comparison each."""
    edges, left = [], np.arange(len(ids))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = (signatures[left] == signatures[i]).sum(axis=1) >= least
            todo += left[hit].tolist()
            edges += [(int(max(ids[i], x)), int(min(ids[i], x))) for x in ids[left[hit]].tolist() if x != ids[i]]
            left = left[~hit]
    return edges


def _agrees(pairs: DataFrame, heads: DataFrame, least: int) -> DataFrame:
    """pairs (doc_id, lo, v, vlo) with agrees: whether their signatures do not refute the link."""
    first = heads.select("doc_id", "lo", F.col("short").alias("a"))
    second = heads.select(F.col("doc_id").alias("v"), F.col("lo").alias("vlo"), F.col("short").alias("b"))
    both = pairs.join(first.hint("merge"), ["doc_id", "lo"]).join(second.hint("merge"), ["v", "vlo"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in "ab")
                same = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lo", "v", "vlo")), same], ["doc_id", "lo", "v", "vlo", "agrees"])

    return both.select("doc_id", "lo", "v", "vlo", "a", "b").mapInArrow(judge, "doc_id long, lo long, v long, vlo long, agrees boolean")


def _level(keyed: DataFrame, heads: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Verified edges of the documents that share a key, and the rows of keys that stay undecided.

    keyed: key, doc_id, lo. First each document is judged against the least one of its key. Where all agree with it, or
    there are but two, the key is done. Documents of other keys are compared with each other, unless they are more than a
    block holds: those are the undecided ones (key, doc_id, lo, v).
    """
    # Tables of keys are written, so that joins with them shuffle both sides: adaptive execution can then split a hot key.
    sizes = materialise(
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("v"), F.min_by("lo", "doc_id").alias("vlo")).where("n > 1")
    )
    met = materialise(keyed.join(sizes.hint("merge"), "key"))
    judged = materialise(_agrees(met.where("doc_id <> v OR lo <> vlo").select("doc_id", "lo", "v", "vlo").distinct(), heads, least))
    refuted = judged.where("NOT agrees").drop("agrees")
    mixed = materialise(met.where("n > 2").join(refuted.hint("merge"), ["doc_id", "lo", "v", "vlo"], "left_semi").select("key").distinct())
    again = met.where("n > 2").join(mixed.hint("merge"), "key")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        ids = np.array(t["doc_id"].to_pylist(), np.int64)
        found = _agreeing(ids, np.frombuffer(b"".join(t["short"].to_pylist()), np.uint8).reshape(len(ids), -1), least)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    small = again.where(F.col("n") <= BLOCK_DOCS).select("key", "doc_id", "lo")
    near = small.join(heads.select("doc_id", "lo", "short").hint("merge"), ["doc_id", "lo"]).select("key", "doc_id", "short")
    edges = judged.where("agrees").select(F.col("doc_id").alias("u"), "v").unionByName(near.groupBy("key").applyInArrow(compare, "u long, v long"))
    return edges, again.where(F.col("n") > BLOCK_DOCS).select("key", "doc_id", "lo", "v")


def _candidates(heads: DataFrame, percent: int, hashes: int) -> DataFrame:
    """Edges (u, v) that connect all documents that share a band and whose signatures do not refute the link.

    heads: doc_id, lo (with it, the key of a row), keys, short. Signatures go only to rows that share a band. In a band
    with more documents than a block holds, not all of which agree with the least, those are compared that share a second
    such band. Where even two bands are shared by so many, the tie to the least is kept: full sets decide later.
    """
    least = least_agreement(hashes, percent)
    edges, hot = _level(heads.select(F.explode("keys").alias("key"), "doc_id", "lo"), heads, least)
    edges, hot = materialise(edges), materialise(hot)
    if not hot.limit(1).count():
        return edges
    own = hot.groupBy("doc_id", "lo").agg(F.sort_array(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1)
    later = lambda i: F.slice("keys", i + 2, F.size("keys"))
    twos = F.flatten(F.transform("keys", lambda k, i: F.transform(later(i), lambda x: F.xxhash64(k, x))))
    more, left = _level(own.select(F.explode(twos).alias("key"), "doc_id", "lo"), heads, least)
    return edges.unionByName(more).unionByName(left.select(F.col("doc_id").alias("u"), "v"))


def _in_task(group: pa.Table, n: int, hashes: int, percent: int) -> list[tuple[int, int]]:
    """Links (larger id, smaller id) within a block, or between a block's rows and its queries."""
    ids = np.array(group["doc_id"].to_pylist(), np.int64)
    a, b = family(hashes)
    sets = [_set(t, n) for t in group["text"].to_pylist()]
    sig = np.stack([signature(s, a, b) if len(s) else np.zeros(hashes, np.uint32) for s in sets])
    query = np.array(group["query"].to_pylist(), bool)
    start = np.array(group["tree"].to_pylist(), np.int64)
    every = np.arange(len(ids))
    forest = _Forest(start)
    rows, columns = (every[query], every[~query]) if query.any() else (every, every)
    found = _cluster(sets, sig, forest, rows, columns, percent)
    return [(int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))) for i, j in found if ids[i] != ids[j]]


def _blocks(members: DataFrame, key: list[str], n: int, hashes: int, percent: int) -> DataFrame:
    """Links within each group of key; members: doc_id, text, tree, query."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        links = _in_task(t, n, hashes, percent)
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

    return members.groupBy(*key).applyInArrow(run, "u long, v long")


def _verified(candidates: DataFrame, docs: DataFrame, n: int, hashes: int, percent: int) -> DataFrame:
    """Links on full sets that connect whatever is connected. candidates: doc_id, n_shingles, component."""
    loads = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(
        F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1)
    ).cast("int")
    plan = candidates.join(loads.select("component", blocks.alias("blocks")), "component")
    plan = plan.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    members = materialise(
        docs.where("doc_id IS NOT NULL")
        .join(plan.hint("merge"), "doc_id")  # the same plan at every size: candidates grow with the corpus
        .select("doc_id", "text", "component", "blocks", "block", F.col("doc_id").alias("tree"), F.lit(False).alias("query"))
    )
    links = materialise(_blocks(members, ["component", "block"], n, hashes, percent))
    split = members.where("blocks > 1")
    if not split.limit(1).count():
        return links
    # A component of many blocks: first one member of each tree found so far, then, exactly, every member outside the
    # component's largest tree against all others, block by block.
    for last in (False, True):
        trees = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("root"))
        now = split.drop("tree", "query").join(trees, "doc_id", "left").withColumn("tree", F.coalesce("root", "doc_id")).drop("root")
        counts = now.groupBy("component", "tree").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("component").agg(F.max_by("tree", F.struct("n", F.col("tree"))).alias("largest"), F.count(F.lit(1)).alias("trees"))
        now = now.join(best, "component").where("trees > 1")
        if not last:
            heads = now.where("doc_id = tree").withColumn("query", F.lit(False))
            heads = heads.withColumn("block", F.pmod(F.xxhash64("tree"), F.ceil(F.col("trees") / BLOCK_DOCS)).cast("int"))
            new = _blocks(heads, ["component", "block"], n, hashes, percent)
        else:
            asked = now.where("tree <> largest")
            parts = asked.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("parts"))
            rows = now.join(parts, "component")
            queries = rows.where("tree <> largest").select(
                "component", "doc_id", "text", "tree", F.lit(True).alias("query"),
                F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"),
            )
            all_rows = rows.select(
                "component", "doc_id", "text", "tree", F.lit(False).alias("query"), "block",
                F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
            )
            new = _blocks(queries.unionByName(all_rows), ["component", "block", "part"], n, hashes, percent)
        links = materialise(links.unionByName(new))
    return links


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = 28,
    rows: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups documents whose word-shingle sets have a Jaccard similarity of percent / 100 or more, transitively.

    Equal sets are one class (a copy costs no comparison). A class has bands * rows hash minima; signatures of classes
    that share a band are compared, and those that agree are tied. Components of these ties are dealt to tasks in bounded
    blocks, where full sets confirm links, until what is linked is connected; components too large for a block are
    finished by comparing whatever is outside their largest tree with all their rows. Approximations: a pair of exactly
    the least similarity s shares no band with probability (1 - s ** rows) ** bands (1e-9 at 0.85, 4e-7 at 0.8), and its
    signatures refute it with one of about 1e-9 at 0.85 and 1e-8 at 0.8 (SLACK). Of bands that more than BLOCK_DOCS classes
    share, some of which are refuted, a pair must share two, or another: it does not with 3e-8 at 0.85, 8e-6 at 0.8.

    Returns doc_id, n_shingles, component_id (least doc_id of the component), kept (doc_id = component_id), a row for
    each row of docs. Texts that are null or have no words have an empty set and stay alone, as do rows with null id
    (component_id null, kept true). Rows that share an id count as linked. Fewer words than a shingle has: the whole
    sequence is the one shingle. An empty table gives no rows. Other columns are ignored.
    """
    hashes = bands * rows
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measured = materialise(_signatures(slim, shingle_words, bands, rows))
    # All rows of a class have the same signature; copies are counted out before the shuffle.
    heads = materialise(
        measured.where("doc_id IS NOT NULL AND n_shingles > 0")
        .groupBy("set_hi", F.col("set_lo").alias("lo"))
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("short").alias("short"))
    )
    classes = heads.select("set_hi", F.col("lo").alias("set_lo"), F.col("doc_id").alias("least"))
    sized = components(_candidates(heads, percent, hashes)).withColumnRenamed("node", "doc_id").join(
        heads.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id"
    )
    links = _verified(materialise(sized), slim, shingle_words, hashes, percent)
    # A copy takes its class's component, so a large class is no large star of edges. Only ids that several rows share
    # can tie classes together beyond the links.
    rowed = materialise(measured.drop("keys", "short").join(classes, ["set_hi", "set_lo"], "left").select("doc_id", "n_shingles", "least"))
    shared = materialise(
        rowed.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("least").alias("first"), F.max("least").alias("last"), F.count_if(F.col("least").isNull()).alias("without"))
        .where("first < last OR (first IS NOT NULL AND without > 0)")
        .select("doc_id", "first")
    )
    ties = rowed.join(shared, "doc_id").where("least <> first").select(F.col("least").alias("u"), F.col("first").alias("v"))
    found = components(links.unionByName(ties.distinct()))
    component = F.coalesce("component", "head", "doc_id")
    return (
        rowed.join(shared, "doc_id", "left")
        .withColumn("head", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "first")))
        .join(found.withColumnRenamed("node", "head"), "head", "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """docs without the rows whose component has a smaller id. Of rows that share a kept id the one whose text sorts
    first stays (of equal texts, one of them; a null text sorts first); rows with null id all stay. All columns,
    whatever their names, stay as they were."""
    gone_id, place = unused(docs.columns, "gone"), unused(docs.columns, "place")
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **kwargs)
    gone = found.where("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct()
    kept = docs.join(gone, docs[id_col].cast("long") == F.col(gone_id), "left_anti")
    order = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_first())
    known = kept.where(F.col(id_col).isNotNull()).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return known.unionByName(kept.where(F.col(id_col).isNull()))
