"""Operator 4: n-gram Jaccard self-join by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes. It is cut into fragments, and a document's
set falls into one segment per fragment.

Candidates. Two sets that reach the threshold differ in at most D n-grams, so if one has more than D
filled fragments, some fragment of both is filled alike. Documents of a size class share a number of
fragments that grows with the class; each filled fragment gives a signature of its whole content. Small sets
use fragments of one n-gram each. A signature that many sets have (boilerplate, passages) says little: it
is passed over wherever a set has more than D other ones, and kept where it has not, so no pair is lost.

Large groups. Equal sets are one class. In a bucket of equal signatures every class is first compared with
one leader, so a group of near copies costs as many pairs as members. Only where a bucket then still holds
several components are the pairs between components compared too, after bounds on size and on a parity sketch.
Where such a bucket is large (a template with many unlike fillings), its classes outside the largest component are
looked up by their rarest n-grams instead, so that what all of them share brings no pairs.

Signatures are matched part by part. A part that one signature makes several times heavier than the average is
matched by plain aggregates and a join that Spark can split, so no bucket has to fit in one task.

Short sets. A set with too few filled fragments also gives each of its n-grams as a signature, so two such sets
meet as well; a set that is short and one that is not meet in a fragment of the latter.

Verification. Segments are sent to the leader they are compared with, partial overlaps are counted fragment by
fragment and summed per pair, and the sum decides. Classes are told apart by two 64-bit digests; where unlike sets
share the first, all but one get another key. Exact up to collisions of the 64-bit hashes of n-grams.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, small, thinned
from .components import components
from .shingles import GROUP_BYTES, Shingler, mix

SKETCH = 8  # longs: one parity bit for each of 512 hash classes
WIDE = 512  # larger sets also have a sketch of about as many bits as n-grams
SMALL = 48  # sets below this size use one fragment for each n-gram
GROWTH = 1.5  # of the size classes
COMMON = 64  # a signature of more classes than this is passed over where possible
PART_SIGNATURES = 400_000  # signatures matched in one group
HEAVY = 4  # a part with so many times the average is not matched in one group
VERIFY_FRAGMENTS = 8


class Plan:
    """Sizes, bounds and fragment counts for a threshold num / den (at least 2 / 3)."""

    def __init__(self, num: int, den: int, slack: float):
        if not 2 * den <= 3 * num <= 3 * den:
            raise ValueError("the threshold must lie between 2/3 and 1")
        self.num, self.den, self.slack = num, den, slack
        self.top = [SMALL]  # first size beyond each class
        while self.top[-1] < 1 << 40:
            self.top.append(int(self.top[-1] * GROWTH))
        self.tops = np.array(self.top)

    def space(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, n, side="right")

    def fragments(self, space: int) -> int:
        """0: one for each n-gram."""
        return 0 if space == 0 else int(self.top[space] * (self.den - self.num) / self.num * self.slack) + 6

    def differ(self, n: int, space: int, own: bool) -> int:
        """Most n-grams in which a set of size n and a linked partner met in this class can differ."""
        partner = n * self.den // self.num
        if not own:
            partner = min(partner, self.top[space] - 1)
        return (n + partner) * (self.den - self.num) // (self.den + self.num)

    def lower(self, n: int, space: int) -> bool:
        """Whether a set of size n in class `space` can link with one of the class below."""
        return space > 0 and self.num * n <= self.den * (self.top[space - 1] - 1)


def signatures(hashed: np.ndarray, space: int, plan: Plan) -> np.ndarray:
    """Signatures of the filled fragments of one sorted set."""
    cells = plan.fragments(space)
    salt = np.uint64((space + 1) * 0x9FB21C651E98DF25 & (1 << 64) - 1)
    if not cells:
        return mix(hashed + salt)
    cell = ((hashed >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(cell, prepend=np.uint64(cells)))
    return mix(np.add.reduceat(mix(hashed), first) * np.uint64(0xC2B2AE3D27D4EB4F) + cell[first] + salt)


def _digests(hashed: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two digests of each set (sets of n hashes follow each other), and the mixed hashes."""
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    mixed = mix(hashed)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    total2 = np.concatenate([[np.uint64(0)], np.cumsum(mix(mixed + np.uint64(1)), dtype=np.uint64)])
    return mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64), (total2[at[1:]] - total2[at[:-1]]).view(np.int64), mixed


def _parities(mixed: np.ndarray) -> np.ndarray:
    """Parity bits of as many hash classes, a power of two, as the set has n-grams, or a few more. The sketch of half as
    many classes is the exclusive or of its halves."""
    bits = 1 << int(len(mixed) - 1).bit_length()
    odd = np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


ROWS = "id {kind}, th long, n int, d1 long, d2 long, " + ", ".join(f"s{i} long" for i in range(SKETCH)) + ", wide array<long>, own array<long>, low array<long>, n_own int, n_low int, d_own int, d_low int"
#: Signatures that a short set is taken to need: more than it can have, so it passes over none.
ALL = (1 << 31) - 1


def _own(part: np.ndarray, space: int, need: int, plan: Plan) -> tuple[np.ndarray, int]:
    """Signatures of a set in a class, and how many it must keep. A short set adds its n-grams, in a class of their own."""
    found = signatures(part, space, plan)
    if len(found) > need:
        return found, need
    return np.concatenate([found, mix(part ^ np.uint64(0x5851F42D4C957F2D + space))]), ALL


def _describe(k: int, num: int, den: int, slack: float, digest_bits: int):
    def run(batches):
        import pyarrow as pa

        plan, shingler = Plan(num, den, slack), Shingler(k)
        sent: set[tuple[int, int]] = set()
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            for i, j, text, hashed in shingler.sets(texts):
                m = j - i
                n = np.bincount(text, minlength=m)
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
                d1, d2, mixed = _digests(hashed, n)
                d1 >>= 64 - digest_bits
                bits = np.bincount(text * (64 * SKETCH) + (mixed % np.uint64(64 * SKETCH)).astype(np.int64), minlength=m * 64 * SKETCH) & 1
                sketch = np.packbits(bits.astype(np.uint8).reshape(m, -1), axis=1).view(np.int64)
                space = plan.space(n)
                wide, own, low, counts = [], [], [], []
                for t in range(m):
                    size, c = int(n[t]), int(space[t])
                    key = int(d1[t]), int(d2[t])
                    if not size or key in sent:  # a copy: its class has been described by this task
                        wide.append(None), own.append(None), low.append(None), counts.append((0, 0, 0, 0))
                        continue
                    if len(sent) >= 1_000_000:
                        sent.clear()
                    sent.add(key)
                    part = hashed[at[t] : at[t + 1]]
                    wide.append(_parities(mixed[at[t] : at[t + 1]]) if size > WIDE else None)
                    x, need_x = _own(part, c, plan.differ(size, c, True), plan)
                    y, need_y = _own(part, c - 1, plan.differ(size, c - 1, False), plan) if plan.lower(size, c) else (x[:0], 0)
                    counts.append((len(x), len(y), need_x, need_y))
                    own.append(x.view(np.int64)), low.append(y.view(np.int64))
                counts = np.array(counts, dtype=np.int32).reshape(m, 4)
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (wide, own, low)]
                none = n == 0
                columns = [b.column(0).slice(i, m), b.column(1).slice(i, m), pa.array(n.astype(np.int32)), pa.array(d1, mask=none), pa.array(d2, mask=none), *(pa.array(np.ascontiguousarray(sketch[:, s])) for s in range(SKETCH)), *lists, *(pa.array(np.ascontiguousarray(counts[:, c])) for c in range(4))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "th", "n", "d1", "d2", *(f"s{s}" for s in range(SKETCH)), "wide", "own", "low", "n_own", "n_low", "d_own", "d_low"])

    return run


def _dealt(parts: int):
    """Signatures of many documents, sorted into parts: one row for each part and batch. The part, from the upper half
    of a signature, and its lower half stand for it; what else falls together is told apart by the bounds on pairs."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for side in (0, 1):
                lists = b.column(1 + side).combine_chunks() if hasattr(b.column(1 + side), "combine_chunks") else b.column(1 + side)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                sig = lists.flatten().to_numpy(zero_copy_only=False)
                if not len(sig):
                    continue
                key = np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes)
                part = ((sig.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                sig, key, part = sig.astype(np.int32)[order], key[order], part[order]
                first = np.flatnonzero(np.diff(part, prepend=-1))
                offsets = pa.array(np.concatenate([first, [len(part)]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(np.full(len(first), side, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(sig)), pa.ListArray.from_arrays(offsets, pa.array(key))], ["part", "side", "sigs", "keys"])

    return run


SHARED = "sig long, key long, side int, classes int, leader long"


def _matched():
    """Signatures that at least two classes have, with how many have them."""

    def run(table):
        import pyarrow as pa

        sides = np.repeat(table["side"].to_numpy(), pa.compute.list_value_length(table["sigs"]).to_numpy())
        sig, key = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("sigs", "keys"))
        order = np.lexsort((sides, key, sig))
        sig, key, sides = sig[order], key[order], sides[order]
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]) | (sides[1:] != sides[:-1])
        sig, key, sides = sig[keep], key[keep], sides[keep]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        run_of = np.cumsum(new) - 1
        classes = np.bincount(run_of, minlength=1)[run_of] if len(sig) else run_of
        many = classes > 1
        least = key[np.flatnonzero(new)][run_of] if len(sig) else key
        whole = (np.int64(table["part"][0].as_py() if len(table) else 0) << 32) + sig.astype(np.int64)
        return pa.table({"sig": whole[many], "key": key[many], "side": sides[many].astype(np.int32), "classes": classes[many].astype(np.int32), "leader": least[many]})

    return run


def _match(described: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """sig, key, side, classes, leader: signatures that at least two classes have. described: key, own, low."""
    parts = max(96, -(-total // PART_SIGNATURES))
    dealt = described.filter("size(own) > 0").mapInArrow(_dealt(parts), "part int, side int, sigs array<int>, keys array<long>")
    loads = dealt.groupBy("part").agg(F.sum(F.size("sigs")).alias("load"))
    heavy = scratch.write(loads.filter(F.col("load") * parts > HEAVY * total).select("part"), "heavy-parts")
    if not heavy.limit(1).count():
        return scratch.write(dealt.groupBy("part").applyInArrow(_matched(), SHARED), "shared")
    heavy = small(heavy)
    light = dealt.join(heavy, "part", "left_anti").groupBy("part").applyInArrow(_matched(), SHARED)
    each = dealt.join(heavy, "part", "left_semi").select("part", "side", F.explode(F.arrays_zip("sigs", "keys")).alias("s"))
    each = scratch.write(each.select((F.shiftleft(F.col("part").cast("long"), 32) + F.col("s.sigs")).alias("sig"), F.col("s.keys").alias("key"), "side").distinct(), "heavy-signatures")
    held = scratch.write(each.groupBy("sig").agg(F.count("*").cast("int").alias("classes"), F.min("key").alias("leader")).filter("classes > 1"), "heavy-counts")
    return scratch.write(light.unionByName(each.join(held, "sig").select("sig", "key", "side", "classes", "leader")), "shared")


def _keyed(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """d1, d2, key of the classes whose first digest another class has too, but one of each."""
    twice = scratch.write(classes.groupBy("d1").agg(F.count("*").alias("count"), F.min("d2").alias("x2")).filter("count > 1").select(F.col("d1").alias("x1"), "x2"), "twins")
    twins = scratch.write(classes.join(small(twice), F.col("d1") == F.col("x1")).filter("d2 <> x2").select("d1", "d2"), "renamed")
    salt = 0
    while twins.limit(1).count():
        # a further collision has a chance of (twins times classes) in 2 ** 64
        tried = twins.withColumn("key", F.xxhash64("d1", "d2", F.lit(salt)))
        again = tried.groupBy("key").count().filter("count > 1").select("key").union(tried.join(classes.select(F.col("d1").alias("x1")), F.col("key") == F.col("x1")).select("key"))
        if not again.limit(1).count():
            return scratch.write(tried, "keys")
        salt += 1
    return twins.withColumn("key", F.lit(0).cast("long"))


def _with_key(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (d1, d2) with the key of their class."""
    k = small(keys.select(F.col("d1").alias("x1"), F.col("d2").alias("x2"), F.col("key").alias("other")))
    return rows.join(k, (F.col("d1") == F.col("x1")) & (F.col("d2") == F.col("x2")), "left").withColumn("key", F.coalesce("other", "d1")).drop("x1", "x2", "other")


SEGMENTS = "key long, n int, leads boolean, leaders array<long>, fragment int, grams array<long>"


def _segments(k: int, digest_bits: int):
    """Segments of the wanted classes: one row for each class and fragment."""

    def run(batches):
        import pyarrow as pa

        shingler = Shingler(k)
        sent: set[int] = set()
        for b in slices(batches):
            if len(sent) > 1_000_000:
                sent.clear()
            keys = b.column(1).to_pylist()
            fresh = []
            for i, key in enumerate(keys):
                if key not in sent:
                    sent.add(key)
                    fresh.append(i)
            b = b.take(pa.array(fresh, pa.int64()))
            d1, d2 = (b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            for i, j, text, hashed in shingler.sets(b.column(0).to_pylist()):
                if not len(text):
                    continue
                n = np.bincount(text, minlength=j - i)
                x1, x2, _ = _digests(hashed, n)
                same = (x1 >> (64 - digest_bits) == d1[i:j]) & (x2 == d2[i:j])
                fragment = (hashed >> np.uint64(61)).astype(np.int64)
                cut = np.flatnonzero(np.diff(text * VERIFY_FRAGMENTS + fragment, prepend=-1))
                grams = pa.ListArray.from_arrays(pa.array(np.concatenate([cut, [len(text)]]).astype(np.int32)), pa.array(hashed.view(np.int64)))
                rows = pa.array(text[cut] + i)
                out = pa.RecordBatch.from_arrays([b.column(1).take(rows), pa.array(n[text[cut]].astype(np.int32)), b.column(4).take(rows), b.column(5).take(rows), pa.array(fragment[cut].astype(np.int32)), grams], ["key", "n", "leads", "leaders", "fragment", "grams"])
                yield out.filter(pa.array(same[text[cut]]))

    return run


def _grams(docs: DataFrame, wanted: DataFrame, classes: DataFrame, k: int, digest_bits: int, scratch: Scratch) -> DataFrame:
    """SEGMENTS of the classes in wanted (key, leads, leaders), each once. docs: id, th, text."""
    about = scratch.write(classes.select("key", "d1", "d2", "least").join(wanted, "key").select("key", "d1", "d2", "leads", "leaders", F.col("least.id").alias("least_id"), F.col("least.th").alias("least_th")), "wanted")
    maybe = thinned(docs, F.xxhash64("id", "th"), about.select(F.xxhash64("least_id", "least_th").alias("h")))
    n_rows, n_leaders = about.agg(F.count("*"), F.sum(F.size("leaders"))).first()
    side = F.broadcast(about) if n_rows + (n_leaders or 0) <= 300_000 else about
    rows = maybe.join(side, F.col("id").eqNullSafe(F.col("least_id")) & (F.col("th") == F.col("least_th")))
    found = scratch.write(rows.select("text", "key", "d1", "d2", "leads", "leaders").mapInArrow(_segments(k, digest_bits), SEGMENTS), "segments")
    if found.groupBy("key", "fragment").count().filter("count > 1").limit(1).count():  # rows that repeat id and text
        found = scratch.write(found.dropDuplicates(["key", "fragment"]), "segments")
    return found


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, digest_bits: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs (leader, key) of classes that reach the threshold, as (a, b), by partial overlaps."""
    none = F.array().cast("array<long>")
    members = pairs.groupBy("key").agg(F.collect_set("leader").alias("leaders")).withColumn("leads", F.lit(False))
    leaders = pairs.select(F.col("leader").alias("key")).distinct().select("key", none.alias("leaders"), F.lit(True).alias("leads"))
    wanted = members.unionByName(leaders).groupBy("key").agg(F.max("leads").alias("leads"), F.flatten(F.collect_list("leaders")).alias("leaders"))
    found = _grams(docs, wanted, classes, k, digest_bits, scratch)
    left = found.filter("leads").select(F.col("key").alias("leader"), "fragment", F.col("grams").alias("x"), F.col("n").alias("na"))
    right = found.select(F.explode("leaders").alias("leader"), F.col("key").alias("b"), "fragment", F.col("grams").alias("y"), F.col("n").alias("nb"))
    partial = right.join(left, ["leader", "fragment"]).select("leader", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("part"))
    summed = partial.groupBy("leader", "b").agg(F.sum("part").alias("both"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    linked = scratch.write(summed.filter(F.lit(den) * F.col("both") >= F.lit(num) * (F.col("na") + F.col("nb") - F.col("both"))).select(F.least("leader", "b").alias("a"), F.greatest("leader", "b").alias("b")), "linked")
    scratch.drop(found)
    return linked


def _by_prefix(docs: DataFrame, about: DataFrame, minor: DataFrame, classes: DataFrame, k: int, digest_bits: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs (leader, key), of different components, of a class in minor (key) and one in about (key, component) that may link.

    A set that links with another holds one of its n-grams among any few of its own, as many as may differ and one more.
    These are its rarest here, looked up among all n-grams of the other classes. Where the first one shared comes, what is
    left of the set must still suffice for the overlap needed.
    """
    wanted = about.select("key", F.lit(False).alias("leads"), F.array().cast("array<long>").alias("leaders"))
    segments = _grams(docs, wanted, classes, k, digest_bits, scratch)
    # dealt out evenly first: each class becomes as many rows as it has n-grams
    grams = scratch.write(segments.repartition("key").select("key", "n", F.explode("grams").alias("gram")).join(about, "key"), "open-grams")
    scratch.drop(segments)
    rarity = scratch.write(grams.groupBy("gram").agg(F.count("*").alias("holders")).filter("holders > 1"), "rarity")
    own = grams.join(minor, "key", "left_semi")
    # n-grams of one class alone bring no pair; they are the rarest, so they only move the others back
    mine = Window.partitionBy("key")
    ranked = own.join(rarity, "gram").withColumn("at", F.col("n").cast("long") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("holders", "gram")))
    size = F.col("n").cast("long")
    prefix = scratch.write(ranked.filter(F.lit(den) * (size - F.col("at") + 1) >= F.lit(num) * size).select("key", "n", "component", "gram", "at"), "prefixes")
    n, m = F.col("x.n").cast("long"), F.col("y.n").cast("long")
    enough = ((n - F.col("x.at") + 1) * (num + den) >= num * (n + m)) & (den * F.least(n, m) >= num * F.greatest(n, m))
    joined = prefix.alias("x").join(grams.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") != F.col("y.component")) & enough)
    pairs = scratch.write(joined.select(F.least("x.key", "y.key").alias("leader"), F.greatest("x.key", "y.key").alias("key")).distinct(), "prefix-pairs")
    scratch.drop(grams, rarity, prefix)
    return pairs


def _bounds(num: int, den: int):
    """Whether the sizes and sketches of x and y leave a link possible; each differing n-gram flips one parity bit."""
    n, m = F.col("x.n").cast("long"), F.col("y.n").cast("long")
    flips = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & (flips * (den + num) <= (n + m) * (den - num))


def _wide_bounds(num: int, den: int):
    """The same by the wide sketches, where both have one. That of the larger set may be twice as long: it is folded."""
    x, y = F.col("x.wide"), F.col("y.wide")
    long, short = F.when(F.size(x) >= F.size(y), x).otherwise(y), F.when(F.size(x) >= F.size(y), y).otherwise(x)
    flips = F.expr("""aggregate(sequence(0, size(short) - 1), 0, (a, i) -> a + bit_count(short[i] ^ long[i] ^ if(size(long) > size(short), long[i + size(short)], 0L)))""")
    both = x.isNotNull() & y.isNotNull()
    return long.alias("long"), short.alias("short"), F.when(F.col("both"), flips * (den + num) <= F.col("sizes") * (den - num)).otherwise(True), both.alias("both")


def _possible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (leader, key) that sizes and sketches leave possible."""
    about = classes.select(F.col("key").alias("k"), "n", *(f"s{i}" for i in range(SKETCH)), "wide")
    near = pairs.join(about.alias("x"), F.col("leader") == F.col("x.k")).join(about.alias("y"), pairs["key"] == F.col("y.k")).filter(_bounds(num, den))
    long, short, enough, both = _wide_bounds(num, den)
    return near.select("leader", pairs["key"], long, short, both, (F.col("x.n").cast("long") + F.col("y.n")).alias("sizes")).filter(enough).select("leader", "key")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, slack: float = 1.1, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 64) -> DataFrame:
    """One row per row of docs: id, n_shingles (size of its set of word n-grams), component_id.

    Two documents link when den * |intersection| >= num * |union|; component_id is the least id that links
    reach, the document itself included. Null and empty texts have an empty set and link with nothing. Copies,
    repeated rows and ties of size share a class. Rows with a null id are compared like others, and get
    the least id of their component that is not null, or null. Further columns are ignored; an empty table gives none.
    The result is a table in the shared folder; all others that the join writes are deleted. digest_bits, of the first
    digest of a class, is there for tests.
    """
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        return scratch.result(_components(docs, kind, words, num, den, slack, digest_bits, scratch).withColumnsRenamed({"id": id_col}))


def _components(docs: DataFrame, kind: str, words: int, num: int, den: int, slack: float, digest_bits: int, scratch: Scratch) -> DataFrame:
    described = scratch.write(docs.mapInArrow(_describe(words, num, den, slack, digest_bits), ROWS.format(kind=kind)), "described")
    numbers = ["n", *(f"s{i}" for i in range(SKETCH)), "wide", "n_own", "n_low", "d_own", "d_low"]
    # the least id, nulls last; the text's hash tells apart rows that share it
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("least")
    digested = scratch.write(described.filter("n > 0").groupBy("d1", "d2").agg(least, *(F.max(c).alias(c) for c in numbers)), "digested")
    keys = _keyed(digested, scratch)
    classes = scratch.write(_with_key(digested, keys), "classes")
    rows = scratch.write(_with_key(described.select("id", "n", "d1", "d2"), keys).select("id", "n", "key"), "rows")

    total = described.agg(F.sum(F.coalesce(F.size("own"), F.lit(0)) + F.coalesce(F.size("low"), F.lit(0)))).first()[0] or 0
    shared = _match(_with_key(described.select("d1", "d2", "own", "low"), keys).select("key", "own", "low"), total, scratch)
    scratch.drop(described, digested, rounds=3)

    # Common signatures go where a class has enough others.
    common = shared.filter(F.col("classes") > COMMON)
    skipped = common.groupBy("key", "side").count().join(classes.select(F.col("key").alias("k"), "n_own", "n_low", "d_own", "d_low"), F.col("key") == F.col("k"))
    n_all, need = (F.when(F.col("side") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("n_own", "n_low"), ("d_own", "d_low")))
    needy = skipped.filter(n_all - F.col("count") <= need).select("key", "side")
    needy = scratch.write(common.join(needy, ["key", "side"], "left_semi").select("sig", "key"), "common")
    # The class with most of these signatures is the least altered member of its group: it links with all that link
    # with any other, or nearly so. It leads its buckets.
    score = scratch.write(needy.groupBy("key").agg(F.count("*").alias("score")).withColumnRenamed("key", "of"), "scores")
    hubs = scratch.write(needy.join(score, F.col("key") == F.col("of")).groupBy("sig").agg(F.max(F.struct("score", "key")).alias("hub")), "hubs")
    led = needy.join(hubs.select(F.col("sig").alias("of"), F.col("hub.key").alias("leader")), F.col("sig") == F.col("of")).select("sig", "key", "leader")
    kept = scratch.write(shared.filter(F.col("classes") <= COMMON).select("sig", "key", "leader").union(led), "buckets")
    scratch.drop(shared, needy, score, hubs)

    about = classes.select("key", "n", *(f"s{i}" for i in range(SKETCH)))
    near = scratch.write(kept.filter("leader <> key").select("leader", "key").distinct(), "led")
    star = scratch.write(_possible(near, classes, num, den), "pairs")
    linked = _verified(docs, star, classes, words, digest_bits, num, den, scratch)
    found = scratch.write(components(linked, scratch), "components")

    # Buckets that still hold several components: the pairs between those.
    part = [found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in ("leader", "key")]
    parted = near.join(part[0], "leader", "left").join(part[1], "key", "left").filter(F.coalesce("c_leader", "leader") != F.coalesce("c_key", "key"))
    open_ = kept.join(parted.select("leader", "key"), ["leader", "key"], "left_semi").select("sig").distinct()
    rest = kept.join(open_, "sig", "left_semi").select("sig", "key").join(about, "key").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    rest = scratch.write(rest, "open")
    scratch.drop(kept, near)
    large = scratch.write(rest.groupBy("sig").count().filter(F.col("count") > COMMON).select("sig"), "large-buckets")
    few = rest
    if many := large.limit(1).count():
        few = scratch.write(rest.join(large, "sig", "left_anti"), "open-small")
    cross = few.alias("x").join(few.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & _bounds(num, den))
    cross = cross.select(F.col("x.key").alias("leader"), F.col("y.key").alias("key"))
    if many:
        # In each bucket the component with most classes has been joined within: every pair left has a member outside it.
        crowd = scratch.write(rest.join(large, "sig", "left_semi"), "open-large")
        sizes = crowd.groupBy("sig", F.col("component").alias("c")).count()
        major = scratch.write(sizes.groupBy(F.col("sig").alias("of")).agg(F.max(F.struct("count", "c")).alias("major")), "majors")
        minor = scratch.write(crowd.join(major, (F.col("sig") == F.col("of")) & (F.col("component") != F.col("major.c"))).select("key").distinct(), "minor-classes")
        crowd = scratch.write(crowd.select("key", "component").distinct(), "open-classes")
        cross = cross.union(_by_prefix(docs, crowd, minor, classes, words, digest_bits, num, den, scratch))
    tried = star.select(F.least("leader", "key").alias("leader"), F.greatest("leader", "key").alias("key"))
    more = scratch.write(cross.distinct().join(tried, ["leader", "key"], "left_anti"), "cross-pairs")
    more = scratch.write(_possible(more, classes, num, den), "pairs")
    if more.limit(1).count():
        linked = linked.union(_verified(docs, more, classes, words, digest_bits, num, den, scratch))
        found = scratch.write(components(linked, scratch), "components")

    named = classes.select("key", F.col("least.id").alias("least_id")).join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "least_id", F.coalesce("component", "key").alias("component"))
    named = scratch.write(named, "named")
    least = scratch.write(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "least")
    of_class = scratch.write(named.join(least, "component").select("key", "component_id"), "class-components")
    out = rows.join(of_class, "key", "left")
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
