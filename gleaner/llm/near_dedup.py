"""Operator 6: near-duplicate groups by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import shingles as S
from gleaner.llm.common import Scratch
from gleaner.llm.components import connected_components

#: Coordinates of a sketch, and how many of them make a band.
T, R = 128, 4
#: Rows of a bucket that are compared with as many others at once; a larger bucket is dealt out in blocks of this size.
BLOCK = 256
Batches = Iterator[pa.RecordBatch]


def _lists(words: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(words.view(np.int64)))


def _sketcher(k: int) -> Callable[[Batches], Batches]:
    """Of each text its set's size, two sums that stand for the set, bands, bitmap and the packed text."""

    def run(batches: Batches) -> Batches:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, texts, hashes = batch.columns
            for i, j, data, off in S.chunks(texts):
                s, n = S.shingle_sets(*S.word_hashes(data, off), k)
                sketch = S.sketches(s, n, T)
                at = np.concatenate(([0], np.cumsum(n)))
                sums = [np.concatenate(([S.U(0)], np.cumsum(S.mix(s, seed)))) for seed in (7, 11)]
                bands = np.zeros((j - i, T // R), dtype=S.U)
                for r in range(R):
                    bands += S.mix(sketch[:, r::R], 31 + r)
                bands = S.mix(bands + np.arange(T // R, dtype=S.U))
                words, width = S.bitmaps(s, n)
                packed = [press.compress(data[a:b].tobytes()) if m else None for a, b, m in zip(off[:-1], off[1:], n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        hashes.slice(i, j - i),
                        pa.array(n),
                        *(pa.array((c[at[1:]] - c[at[:-1]]).view(np.int64)) for c in sums),
                        _lists(bands.ravel(), np.arange(j - i + 1) * (T // R)),
                        _lists(words, np.concatenate(([0], np.cumsum(width)))),
                        pa.array(packed, type=pa.binary()),
                    ],
                    names=["doc_id", "h", "n", "k1", "k2", "bands", "bits", "z"],
                )

    return run


def _can_reach(num: int, den: int) -> Callable[[Batches], Batches]:
    """Of the pairs (a, b, n, m, x, y: their sizes and bitmaps) those that can have the similarity ``num / den``, exactly bounded."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            x, y = batch.column(4), batch.column(5)
            flat = [c.flatten().to_numpy().view(S.U) for c in (x, y)]
            off = [c.offsets.to_numpy().astype(np.int64) - c.offsets[0].as_py() for c in (x, y)]
            wide = [np.diff(o) for o in off]
            keep = np.zeros(len(a), dtype=bool)
            for p, q in {*zip(wide[0].tolist(), wide[1].tolist(), strict=True)}:
                at = np.flatnonzero((wide[0] == p) & (wide[1] == q))
                one, two = (f[o[at][:, None] + np.arange(w)] for f, o, w in zip(flat, off, (p, q), strict=True))
                both = S.most_in_common(n[at], one, m[at], two)
                keep[at] = den * both >= num * (n[at] + m[at] - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def _verifier(k: int, num: int, den: int) -> Callable[[Batches], Batches]:
    """Keeps the pairs (a, b, za, zb) with ``den * |A & B| >= num * |A | B|``, over their full shingle sets."""

    def sets(z: list[bytes]) -> list[np.ndarray]:
        open_ = zstandard.ZstdDecompressor()
        out: list[np.ndarray] = []
        for _, _, data, off in S.chunks(pa.array([open_.decompress(x) for x in z], type=pa.large_binary())):
            s, n = S.shingle_sets(*S.word_hashes(data, off), k)
            out += np.split(s, np.cumsum(n)[:-1])
        return out

    def run(batches: Batches) -> Batches:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), dtype=bool)
            for at in range(0, len(a), 256):
                za, zb = batch.column(2).slice(at, 256).to_pylist(), batch.column(3).slice(at, 256).to_pylist()
                one = list(dict.fromkeys(za + zb))
                made = dict(zip(one, sets(one), strict=True))
                for i, (x, y) in enumerate(zip(za, zb, strict=True)):
                    m = np.concatenate((made[x], made[y]))
                    m.sort(kind="stable")
                    same = int((m[1:] == m[:-1]).sum())
                    keep[at + i] = den * same >= num * (len(m) - same)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def _blocks(num: int, den: int) -> Callable[[Batches], Batches]:
    """Pairs of a row that asks and another row of its group ``g`` (rows come sorted by it) that can be linked, with the most
    similarity that they can have.

    A pair comes out if its rows are of different components, their sizes and bitmaps allow the similarity, and no
    earlier band of the two agrees (else that band's bucket has it).
    """

    def group(t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        qa, qb = np.flatnonzero(t["asks"]), np.flatnonzero(~t["asks"])
        ids, comp, main, n, bits, bands = (t[c] for c in ("id", "comp", "main", "n", "bits", "bands"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(qa) and len(qb):
            here = int(np.argmax(bands[qa[0]] == t["key"].view(S.U)[qa[0]]))
            width = np.array([len(x) for x in bits])
            rows = {w: qb[width[qb] == w] for w in np.unique(width[qb])}
            maps = {w: np.stack([bits[i] for i in r]) for w, r in rows.items()}
            for x in qa:
                for w, r in rows.items():
                    ok = (comp[r] != comp[x]) & (main[r] | (ids[x] < ids[r])) & (den * np.minimum(n[r], n[x]) >= num * np.maximum(n[r], n[x]))
                    if ok.any() and here:
                        ok[ok] = ~(bands[r[ok], :here] == bands[x, :here]).any(axis=1)
                    if not ok.any():
                        continue
                    y = r[ok]
                    both = S.most_in_common(n[x], bits[x], n[y], maps[w][ok])
                    can = den * both >= num * (n[x] + n[y] - both)
                    y, both = y[can], both[can]
                    out.append((np.full(len(y), ids[x]), ids[y], both / (n[x] + n[y] - both)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Batches:
            """Works off the whole groups that are held; the last group may go on in the next batch."""
            table = pa.Table.from_batches(held).combine_chunks()
            n = table.num_rows
            g = table["g"].to_numpy()
            cut = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [n]))
            end = len(cut) - 1 if last else len(cut) - 2
            held.clear()
            if not last:
                held.extend(table.slice(cut[-2]).to_batches())
            cols = {c: table[c].to_numpy(zero_copy_only=False) for c in ("asks", "key", "id", "comp", "main", "n")}
            # Unsigned: numpy counts the bits of a signed number's absolute value.
            cols["bands"] = table["bands"].combine_chunks().flatten().to_numpy().view(S.U).reshape(n, T // R)
            bits = table["bits"].combine_chunks()
            flat, off = bits.flatten().to_numpy().view(S.U), bits.offsets.to_numpy() - bits.offsets[0].as_py()
            for a, b in zip(cut[:end], cut[1 : end + 1], strict=True):
                maps = np.split(flat[off[a] : off[b]], off[a + 1 : b] - off[a])
                found = group({c: v[a:b] for c, v in cols.items()} | {"bits": maps})
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "most"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from flush(False)
        if held:
            yield from flush(True)

    return run


def _grouped(spark: SparkSession, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id and kept of each row of ``docs``."""
    scratch = Scratch(spark, "near")
    kind = dict(docs.dtypes)["doc_id"]
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    made = given.mapInArrow(_sketcher(k), f"doc_id {kind}, h long, n long, k1 long, k2 long, bands array<long>, bits array<long>, z binary")
    # The number of a row is drawn once, as it is written here; the least of a class's rows is the class's id and stands for it.
    made = scratch.keep(made.withColumn("row", F.monotonically_increasing_id()), "sketches")
    some = made.where("n > 0")
    classes = scratch.keep(some.groupBy("k1", "k2").agg(F.min("row").alias("id"), F.min("doc_id").alias("rep")), "classes")
    shapes = some.select(F.col("row").alias("id"), "n", "bits", "bands").join(classes.select("id"), "id", "left_semi")
    shapes = scratch.keep(shapes, "shapes")

    in_band = shapes.select("id", F.explode("bands").alias("key"))
    hubs = in_band.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # Sums of hot keys are written before they are joined: a join whose two sides are dealt out for it can be split by Spark.
    hubs = scratch.keep(hubs.select("key", "hub"), "hubs")
    met = scratch.keep(in_band.join(hubs, "key").select("key", "id", "hub"), "met")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The links among pairs (a, b)."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = scratch.keep(some.select(F.col("row").alias("id"), "z").join(ends, "id", "left_semi"), f"texts-{name}")
        with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a")
        with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
        got = scratch.keep(with_b.select("a", "b", "za", "zb").mapInArrow(_verifier(k, num, den), "a long, b long"), f"links-{name}")
        scratch.drop(f"texts-{name}")
        return got

    # First every member of a bucket meets the one of the least id: a star, not all pairs.
    star = met.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(shapes.select(F.col("id").alias("a"), "n", F.col("bits").alias("x")), "a")
    star = star.join(shapes.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
    star = star.where(f"{den} * least(n, m) >= {num} * greatest(n, m)").select("a", "b", "n", "m", "x", "y")
    star = scratch.keep(star.mapInArrow(_can_reach(num, den), "a long, b long"), "star")
    links = verified(star, "star")
    comp = scratch.keep(connected_components(links, scratch, "cc-star"), "comp-star")

    parts_n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rest(comp: DataFrame, tried: DataFrame, name: str) -> DataFrame:
        """(a, b, most): what may be linked yet within the buckets of several components, without the pairs already tried."""
        of = met.join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        parts = of.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
        mixed = (
            parts.groupBy("key")
            .agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("comps"))
            .where("comps > 1")
            .select("key", F.col("top.comp").alias("main"), F.ceil((F.col("size") - F.col("top.c")) / BLOCK).alias("na"), F.ceil(F.col("size") / BLOCK).alias("nb"))
        )
        mixed = scratch.keep(mixed, f"mixed-{name}")
        live = of.join(mixed, "key").join(shapes, "id")
        spread = lambda n, own: F.when(F.lit(own), F.array(F.pmod(F.xxhash64("id"), F.col(n)))).otherwise(F.sequence(F.lit(0), F.col(n) - 1))
        meet = lambda df, asks: (
            df.withColumn("i", F.explode(spread("na", asks)))
            .withColumn("j", F.explode(spread("nb", not asks)))
            .select(F.xxhash64("key", "i", "j").alias("g"), F.lit(asks).alias("asks"), "key", "id", "comp", (F.col("comp") == F.col("main")).alias("main"), "n", "bits", "bands")
        )
        live = meet(live.where("comp <> main"), True).unionByName(meet(live, False))
        live = live.repartition(parts_n, "g").sortWithinPartitions("g")
        found = live.mapInArrow(_blocks(num, den), "a long, b long, most double")
        tried = tried.select(F.col("a").alias("low"), F.col("b").alias("high"))
        return found.join(tried, (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high")), "left_anti")

    def joined_by(comp: DataFrame, links: DataFrame, pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The components and links with those among ``pairs``."""
        found = None if pairs.isEmpty() else verified(pairs, name)
        if found is None or found.isEmpty():
            return comp, links
        links = links.unionByName(found)
        return scratch.keep(connected_components(links, scratch, f"cc-{name}"), f"comp-{name}"), links

    # Then every class outside its bucket's largest component meets the likeliest partner of another component, and last all
    # that are still of different components, with sizes and bitmaps only: texts go to the pairs that these can't rule out.
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nearest = rest(comp, star, "nearest").groupBy("a").agg(F.max_by("b", F.struct("most", -F.col("b"))).alias("b"))
    nearest = scratch.keep(ordered(nearest), "nearest")
    if not nearest.isEmpty():
        comp, links = joined_by(comp, links, nearest, "nearest")
        left = ordered(rest(comp, star.unionByName(nearest), "rest"))
        comp, links = joined_by(comp, links, scratch.keep(left, "rest"), "rest")

    least = comp.join(classes, "id").groupBy("comp").agg(F.min("rep").alias("least"))
    named = scratch.keep(comp.join(scratch.keep(least, "least"), "comp").select("id", "least"), "named")
    groups = classes.join(named, "id", "left").select("k1", "k2", F.coalesce("least", "rep").alias("least"))
    groups = scratch.keep(groups, "groups")
    out = made.select("doc_id", "h", "n", "k1", "k2").join(groups, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Groups texts whose sets of ``k``-word shingles have a Jaccard similarity of ``num / den`` or more.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (doc_id =
    component_id), one row for each row of ``docs`` (doc_id of any ordered type, text; other columns are not read).

    - A null, empty or blank text has the empty set: n_shingles 0, linked with nothing, its own component, kept.
    - A text of fewer than ``k`` words has its whole word sequence as its one shingle.
    - One doc_id with several texts: each row is in the group of its own text.
    - A null doc_id names no group: its row is kept unless its group has a row with a doc_id.
    - Rows of equal sets form one class, which the smallest doc_id names; classes of any size meet only in a
      map-side-combined minimum. Repeated rows give repeated rows. An empty table gives an empty result.
    - Words and shingles are compared by 64-bit hashes, sets by two sums of 64 bits; n_shingles counts distinct hashes.

    Classes are sketched with ``T`` coordinates that are all filled, cut in bands of ``R``. A pair at similarity 0.8 shares
    none of the 32 bands once in 2 * 10^7 pairs; of the pairs that share one none is passed over but by an exact bound on
    their similarity, from sizes and bitmaps of the full sets. In each band bucket first every class is compared with the smallest (a star,
    not all pairs). Where a bucket still holds several components, every class outside the bucket's largest is then
    compared in blocks, by size and bitmap, with every class of another component: first its likeliest partner is
    verified, then, over what is left, all that the bound allows. All links are confirmed on full shingle sets. There is
    no cap on buckets or pairs.
    """
    return _grouped(spark, docs, k, num, den).drop("h")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that are kept of their near-duplicate group, all columns unchanged. Rows that repeat a kept row's doc_id and
    text stay; so do rows without a doc_id, unless their group has a row with one."""
    kept = _grouped(spark, docs, k, num, den).where("kept").select("doc_id", "h").distinct()
    text_hash: Column = F.xxhash64(docs["text"])
    named, bare = kept.where("doc_id is not null"), kept.where("doc_id is null").select("h")
    same = (docs["doc_id"] == named["doc_id"]) & (text_hash == named["h"])
    return docs.join(named, same, "left_semi").unionByName(docs.where("doc_id is null").join(bare, text_hash == bare["h"], "left_semi"))
