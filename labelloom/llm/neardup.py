"""Near-duplicates by MinHash bands and odd sketches (operator 2).

Documents with the same shingle set fold into one node at once, however many there are.
Nodes meet in the buckets of MinHash bands. Places in buckets where too many of a node's
shingles are its own for any link are given up. Then every node is compared to the head of
each of its buckets, which joins groups of copies without pairing them all; and the nodes
that are not yet joined to their bucket's head are compared, by prefix filtering, to all others
outside their own component, so no link between components is passed over. Pairs
must be close by the exclusive-or of their odd sketches before their full sets are compared.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm import storage
from labelloom.llm.words import as_bytes

SHINGLE = 5
PERCENT = 80
#: 40 bands of 6 of the 240 samples: a pair of similarity 0.8 shares no band with probability
#: (1 - 0.8**6)**40 = 5e-6, one of similarity 0.3 shares one in 3 % of cases.
BANDS, ROWS = 40, 6
SKETCH_BITS = 512
#: The sketch of a pair may estimate a similarity lower by so many standard deviations.
SIGMAS = 6
_CHUNK = 8192


def shingle_hashes(text: bytes | None, k: int):
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), dtype=np.uint64, count=len(number))
    h = table[np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))]
    base = np.uint64(0x9E3779B97F4A7C15)
    size = min(k, len(words))
    mixed = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        mixed = (mixed ^ h[j : len(h) - size + 1 + j]) * base
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _functions():
    """Factors and masks of the sample's hash functions."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(11))
    factor = rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factor[:, None], rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]


def samples_of(hashes, functions):
    """MinHash samples: for each hash function the least value over the set."""
    import numpy as np

    factor, mask = functions
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(factor), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(folded), _CHUNK):
        np.minimum(least, ((folded[None, at : at + _CHUNK] ^ mask) * factor).min(axis=1), out=least)
    return least


def _bands(samples):
    import numpy as np

    parts = samples.reshape(BANDS, ROWS).astype(np.uint64)
    mixed = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for j in range(ROWS):
        mixed = (mixed ^ parts[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64)


def odd_sketch(samples):
    """Parity bitmap of (function number, sample) pairs, as 64-bit words."""
    import numpy as np

    mixed = (samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    spot = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(spot, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def most_odd_bits(percent: int, size: int = BANDS * ROWS) -> int:
    """Exclusive-or bits that a pair at the threshold stays under but for chance.

    The estimate of a similarity from ``size`` samples has a standard deviation of
    sqrt(s (1 - s) / size); of each differing sample two bits flip.
    """
    import math

    s = percent / 100
    low = max(0.0, s - SIGMAS * math.sqrt(s * (1 - s) / size))
    flips = 2 * size * (1 - low)
    mean = SKETCH_BITS * (1 - (1 - 2 / SKETCH_BITS) ** flips) / 2
    return min(SKETCH_BITS, math.ceil(mean + SIGMAS * math.sqrt(SKETCH_BITS) / 4))


def _signer(k: int):
    @F.arrow_udf("node binary, n_shingles long, bands array<long>, sketch array<long>")
    def sign(column: pa.Array) -> pa.Array:
        import hashlib

        functions = _functions()
        nodes, sizes, bands, sketches = [], [], [], []
        for text in as_bytes(column):
            hashes = shingle_hashes(text, k)
            sizes.append(len(hashes))
            if not len(hashes):
                nodes.append(None)
                bands.append(None)
                sketches.append(None)
                continue
            samples = samples_of(hashes, functions)
            nodes.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
            bands.append(_bands(samples))
            sketches.append(odd_sketch(samples))
        longs = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, longs), pa.array(sketches, longs)], ["node", "n_shingles", "bands", "sketch"])

    return sign


def _shingler(k: int):
    @F.arrow_udf("array<long>")
    def cut(column: pa.Array) -> pa.Array:
        import numpy as np

        return pa.array([shingle_hashes(text, k).view(np.int64) for text in as_bytes(column)], pa.list_(pa.int64()))

    return cut


def _odd_bits(a: str, b: str) -> Column:
    return sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _close(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets are similar enough."""

    def side(table: DataFrame, c: str) -> DataFrame:
        return table.select(*[F.col(x).alias(f"{c}_{x}" if x != "node" else c) for x in table.columns])

    light = nodes.select("node", "n_shingles", "sketch")
    met = pairs.join(side(light, "a"), "a").join(side(light, "b"), "b")
    sizes = (100 * F.least("a_n_shingles", "b_n_shingles") >= percent * F.greatest("a_n_shingles", "b_n_shingles"))
    likely = met.where(sizes & (_odd_bits("a_sketch", "b_sketch") <= most_odd_bits(percent))).select("a", "b")
    full = likely.join(side(sets, "a"), "a").join(side(sets, "b"), "b")
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return full.where(100 * common >= percent * (F.size("a_shingles") + F.size("b_shingles") - common)).select("a", "b")


def _linkable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(band, node, head): places in buckets where a link is possible at all.

    A node with ``own`` shingles that no other set has can share no more than the rest, and
    the union with a partner has at least ``own`` more than the partner. So it can be linked
    in a bucket only if rest / (partner + own) is high enough for the smallest partner there.
    Heavily edited copies of one text, which meet in the same buckets in great numbers without
    being similar enough to anything, fall out here by proof and not by a cap. The head of a
    bucket is the node with the smallest share of own shingles: the likely original.
    """
    ids = [F.xxhash64("node").alias("i1"), F.xxhash64("node", F.lit(1)).alias("i2")]
    holders = sets.select(*ids, F.explode("shingles").alias("shingle")).groupBy("shingle")
    # Where one set alone has a shingle, the exclusive-or over holders is that set's id.
    lone = holders.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("i1").alias("i1"), F.bit_xor("i2").alias("i2")).where("n = 1")
    own = lone.groupBy("i1", "i2").agg(F.count(F.lit(1)).alias("own"))
    sized = sets.select("node", F.size("shingles").alias("n"), *ids).join(own, ["i1", "i2"], "left").select("node", "n", F.coalesce("own", F.lit(0)).alias("own"))
    placed = storage.stored(members.join(sized, "node"), "sized")
    least = placed.groupBy("band").agg(F.min("n").alias("least"))
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    able = placed.join(least, "band").where(100 * (F.col("n") - F.col("own")) >= percent * (partner + F.col("own"))).select("band", "node", "n", "own")
    rank = F.struct((F.col("own") / F.col("n")).alias("share"), F.xxhash64("node", "band").alias("by"), "node")
    heads = able.groupBy("band").agg(F.min(rank).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return able.join(heads.select("band", F.col("head.node").alias("head")), "band").select("band", "node", "head")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node of its component.

    Rounds of large-star and small-star (Kiveris and others, 2014); each hangs neighbours on
    a smaller node and halves long paths, until nothing changes.
    """
    edges = storage.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = storage.stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _across(members: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link different components, of nodes not in their head's component
    with any other node of such buckets.

    By prefix filtering: in one order of all shingles, rarest first, let the first shingle
    that two sets share stand at places i and j. Then they share at most the smaller of
    n_a - i and n_b - j, which must reach the overlap that the similarity asks for. So it is
    enough to join on shingles near the front, and copies that differ in many rare shingles
    do not meet on their common ones.
    """
    placed = members.join(known, "node", "left").select("band", "node", "head", F.coalesce("root", "node").alias("root"))
    heads = known.select(F.col("node").alias("head"), F.col("root").alias("head_root"))
    marked = placed.join(heads, "head", "left").withColumn("apart", F.col("root") != F.coalesce("head_root", "head"))
    open_bands = marked.where("apart").select("band").distinct()
    roles = marked.join(open_bands, "band").groupBy("node", "root").agg(F.max("apart").alias("apart"))
    nodes = storage.stored(sets.join(roles, "node"), "open")
    cut = nodes.select("node", F.explode("shingles").alias("shingle"))
    often = cut.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    ordered = cut.join(often, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("ordered"))
    size = F.size("ordered")
    front = F.slice("ordered", 1, size - F.ceil(size * percent / 100).cast("int") + 1)
    fronts = ordered.select("node", size.alias("n"), F.posexplode(front).alias("at", "s")).select("node", "n", "at", F.col("s.shingle").alias("shingle"))
    fronts = storage.stored(fronts.join(nodes.drop("shingles"), "node"), "fronts")
    left = fronts.where("apart").select("shingle", *[F.col(c).alias(f"a_{c}") for c in ("node", "n", "at", "root")])
    right = fronts.select("shingle", *[F.col(c).alias(f"b_{c}") for c in ("node", "n", "at", "root")])
    reach = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    enough = (100 + percent) * reach >= percent * (F.col("a_n") + F.col("b_n"))
    met = left.join(right, (left["shingle"] == right["shingle"]) & (F.col("a_root") != F.col("b_root")) & enough)
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id that links
    lead to, its own included) and kept (the two ids are equal).

    Null and empty texts have no shingles and are linked with nothing. A null id is larger
    than all others; it is the id of a component only if all its documents have none. Rows
    that repeat an id and a text are all kept or all dropped. Other columns are not read. An
    empty table gives no rows.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("body"))
    signed = storage.stored(base.select("doc_id", "body", _signer(shingle)(F.col("text")).alias("s")).select("doc_id", "body", "s.*"), "signed")
    used = signed.where("node is not null")
    nodes = storage.stored(
        used.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "body")).alias("from")), "nodes"
    )
    slots = nodes.select(F.explode("bands").alias("band"), "node")
    shared = slots.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = storage.stored(slots.join(shared, "band"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "from"), "node")
    # The sets of nodes that meet any other, cut from the text of one document each.
    source = wanted.select("node", F.col("from.doc_id").alias("w_id"), F.col("from.body").alias("w_body"))
    sets = base.join(source, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("body") == F.col("w_body"))).select("node", _shingler(shingle)(F.col("text")).alias("shingles"))
    sets = storage.stored(sets.dropDuplicates(["node"]), "sets")
    members = storage.stored(_linkable(members, sets, percent), "linkable")

    first = members.where("node <> head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    stars = storage.stored(_close(first, nodes, sets, percent), "stars")
    known = storage.stored(components(stars), "roots")
    rest = _across(members, known, sets, percent)
    more = _close(rest, nodes, sets, percent)
    final = storage.stored(components(stars.unionByName(more)), "roots")
    grouped = signed.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = grouped.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    joined = grouped.join(smallest, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "body")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, unchanged, that ``near_duplicates`` keeps."""
    found = near_duplicates(docs, doc_id, text, shingle, percent).where("not kept")
    gone = found.select(F.col("doc_id").alias("id"), F.col("body").alias("h")).distinct().select(F.struct("id", "h").alias("gone"))
    packed = docs.select(F.struct("*").alias("row"), F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h")).alias("key"))
    return packed.join(gone, F.col("key").eqNullSafe(F.col("gone")), "left_anti").select("row.*")
