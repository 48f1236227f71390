"""Near duplicates by Jaccard similarity of word n-grams: an exact join by vertical partitioning.

A document's set holds the 128-bit hashes of its distinct n-grams of lower-cased words.  Hash order is the global
n-gram order; it is cut into fragments (contiguous ranges), every set is cut into segments along them, each
fragment counts what its segments share, and the partial counts are summed, per document and then per pair.

1. Documents of equal sets become one class; its smallest id represents it.
2. Two linked sets share at least l of the first (n - ceil(t n) + l) n-grams of each, in any global order.
   The fragments count, for those n-grams, how many of a document's stand in another document; the sums leave
   only documents that can have a partner.
3. For these, the fragments count each n-gram's documents; rarest first, the first (n - ceil(t n) + 1) n-grams
   of each set are its prefix.  Linked sets share an n-gram of their prefixes.
4. n-grams that no other document has link with nothing.  Documents of equal size that share all others are therefore
   one class again: its members link alike with everything outside, and with each other all or not at all.
5. Groups are closed without all pairs.  Each document is first compared with the one candidate that has the fewest
   n-grams of its own, its centre; the documents of one centre form a cluster, and the links' components are taken.
   Pairs inside a component need no test.
6. Inside a cluster, let C be the centre's shared n-grams, D and A what a document lacks of C and adds to it.  The overlap
   of x and y is |C| - |Dx| - |Dy| + |Dx & Dy| + |Ax & Ay|.  The cluster's member m of the least size and |D| links with each
   member that needs no shared difference; every other member can only link with one that shares some of its
   differences, and a prefix filter on the (small) sets of differences finds these.
7. Pairs of different clusters that share a prefix n-gram and lie in two components are compared as they are, if sizes and
   positions of the n-gram let them reach the threshold.

Hot n-grams: a worker combines its run of texts first, so a fragment gets an n-gram once a run, not once a document
(steps 2 and 3); the number of fragments follows from the measured size of the sets.

Nothing is dropped or capped.  Null or empty texts have empty sets and link with nothing; a null id gets a null
component and links with nothing.  Repeated rows count once as a set; rows of one id with different texts are separate
documents.  Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, numbered, sized_join, stored
from .wordhash import blobs, by_bucket, dealt, edges, firsts, fragment, gathered, grams, mix, order, ranges, runs, scatter, table, word_hashes

#: The overlap of a pair is counted over 2**PAIR_BITS fragments.
PAIR_BITS = 2

_SHARED, _SHARED_SQL = blobs(["hash", "row", "times"])
_SETS, _SETS_SQL = blobs(["row", "n", "hash", "more", "times"])
_FREQUENT, _FREQUENT_SQL = blobs(["hash", "more", "name", "df"])


def _ceil(n, percent: int):
    return (n * percent + 99) // 100


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct n-gram hashes of each text, in two lanes; a text of fewer words is one n-gram."""
    a, b, counts = word_hashes(texts, lower=True)
    whole, begin = (grams(a, k, 0), grams(b, k, 1)), np.append(0, np.cumsum(counts))
    for s, e in zip(begin[:-1], begin[1:], strict=True):
        x, y = (w[s : e - k + 1] for w in whole) if e - s >= k else (grams(a[s:e], e - s, 0), grams(b[s:e], e - s, 1)) if e > s else (a[:0], b[:0])
        by = order(x, y)
        x, y = x[by], y[by]
        one = firsts(x, y)
        yield x[one], y[one]


def _signature(x: np.ndarray, y: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return mix(x + np.uint64(11)).sum(dtype="u8"), mix(y ^ np.uint64(0x5DEECE66D1234567)).sum(dtype="u8")


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 2):
            sets = list(shingle_sets(batch.column(2), k))
            sig = np.array([_signature(*s) for s in sets], "u8").reshape(-1, 2).view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x, _ in sets], pa.int64()), pa.array(sig[:, 0]), pa.array(sig[:, 1])], names=["row", "doc_id", "n", "sig_a", "sig_b"])

    return run


def _first_grams(k: int, n: int, percent: int):
    """The n-grams of step 2.  One that several documents of the run have is counted here for them, and goes to its fragment once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 1):
            row = batch.column(0).to_numpy(zero_copy_only=False).astype("i8")
            sets = [s for s, _ in shingle_sets(batch.column(1), k)]
            sets = [s[: len(s) - _ceil(len(s), percent) + _ceil(len(s), 100 - percent)] for s in sets]
            h = np.concatenate([*sets, np.zeros(0, "u8")])
            own = np.repeat(row, [len(s) for s in sets])
            by = np.argsort(h, kind="stable")
            h, own = h[by], own[by]
            new = firsts(h)
            size = np.diff(edges(new))
            local = np.repeat(size > 1, size)
            rows, times = np.unique(own[local], return_counts=True)
            got = [
                scatter(fragment(mix(h[new]), n), {"hash": h[new], "row": own[new], "times": (size == 1).astype("u4")}),
                scatter(-1 - dealt(rows, n), {"hash": np.zeros(len(rows), "u8"), "row": rows, "times": times.astype("u4")}),
            ]
            yield from (g.select(_SHARED.names) for g in got if g is not None)

    return run


def _shared_rows(n: int):
    """A fragment: which documents have how many n-grams that another run has too, dealt out by document."""

    def run(got: pa.Table) -> pa.Table:
        bucket = got.column("bucket")[0].as_py()
        h, row, times = (gathered(got, x, k) for x, k in (("hash", "u8"), ("row", "i8"), ("times", "u4")))
        if bucket >= 0:
            by = np.argsort(h, kind="stable")
            size = np.diff(edges(firsts(h[by])))
            several = by[np.repeat(size > 1, size)]
            row, times = row[several[times[several] > 0]], None  # the others were counted in their run
        rows, at = np.unique(row, return_inverse=True)
        total = np.bincount(at, times, len(rows)).astype("u4")
        return table(scatter(dealt(rows, n), {"hash": np.zeros(len(rows), "u8"), "row": rows, "times": total}), _SHARED)

    return run


def _sum_shared(got: pa.Table) -> pa.Table:
    rows, at = np.unique(gathered(got, "row", "i8"), return_inverse=True)
    return pa.table({"row": rows, "shared": np.bincount(at, gathered(got, "times", "u4"), len(rows)).astype("i8")})


def _whole_sets(k: int, n: int):
    """The sets of a run of texts under the run's name, and the run's distinct n-grams, counted, for their fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 1):
            row = batch.column(0).to_numpy(zero_copy_only=False).astype("i8")
            sets = list(shingle_sets(batch.column(1), k))
            size = np.array([len(x) for x, _ in sets], "i8")
            a, b = (np.concatenate([*(s[lane] for s in sets), np.zeros(0, "u8")]) for lane in (0, 1))
            if not len(a):
                continue
            name = int(row[0])  # no other run has that row
            cells = [pa.array([x.tobytes()], pa.binary()) for x in (row, size, a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), *cells, pa.array([None], pa.binary()), pa.array([name], pa.int64())], names=[*_SETS.names, "run"])
            by = order(a, b)
            a, b = a[by], b[by]
            new = firsts(a, b)
            got = scatter(fragment(a[new], n), {"hash": a[new], "more": b[new], "times": np.diff(edges(new)).astype("u4")})
            none = pa.nulls(got.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([got.column("bucket"), none, none, got.column("hash"), got.column("more"), got.column("times"), pa.array([name] * got.num_rows, pa.int64())], names=[*_SETS.names, "run"])

    return run


def _frequencies(got: pa.Table) -> pa.Table:
    """A fragment: n-grams that two documents have, with their number of documents and a 64-bit name, for each run that
    has them.  The name is the first lane of the hash; where two n-grams share that, the next free number of the fragment."""
    a, b, times = (gathered(got, x, k) for x, k in (("hash", "u8"), ("more", "u8"), ("times", "u4")))
    run = np.repeat(got.column("run").to_numpy(), [len(x) // 8 for x in got.column("hash").to_pylist()])
    by = order(a, b)
    a, b, times, run = a[by], b[by], times[by].astype("i8"), run[by]
    start = edges(firsts(a, b))
    df = np.add.reduceat(times, start[:-1])
    size = np.diff(start)
    shared = np.repeat(df > 1, size)
    names = a[start[:-1]][df > 1]
    clash = np.flatnonzero(~firsts(names))
    if len(clash):
        taken = set(a.tolist())
        for k in clash:
            name = int(names[k])
            while name in taken:
                name = name + 1 if name < (1 << 64) - 1 else 0
            taken.add(name)
            names[k] = name
    name = np.repeat(names, size[df > 1])
    out = scatter(run[shared], {"hash": a[shared], "more": b[shared], "name": name, "df": np.repeat(df, size)[shared].astype("u4")})
    return table(out, _FREQUENT)


def _prefixes(percent: int):
    """A run's sets and the frequencies of its shared n-grams → (row, n, own, sig_a, sig_b, prefix, grams) for documents that
    keep a prefix n-gram.  own: n-grams that no other document has; they come first in the order and link with nothing.
    sig_a, sig_b: the signature of the others.  grams: their names."""

    def run(key: tuple, sets: pa.Table, frequent: pa.Table) -> pa.Table:
        out: dict[str, list] = {"row": [], "n": [], "own": [], "sig_a": [], "sig_b": [], "prefix": [], "grams": []}
        if sets.num_rows:
            row, size, a, b = (np.frombuffer(sets.column(x)[0].as_py(), k) for x, k in (("row", "i8"), ("n", "i8"), ("hash", "u8"), ("more", "u8")))
            fa, fb, name, df = (gathered(frequent, x, k) for x, k in (("hash", "u8"), ("more", "u8"), ("name", "u8"), ("df", "u4")))
            xa, xb = np.concatenate((fa, a)), np.concatenate((fb, b))
            by = order(xa, xb)  # stable: the frequency comes before the sets that have its n-gram
            new = firsts(xa[by], xb[by])
            lead = by[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            of = np.empty(len(xa), "i8")
            of[by] = lead
            of = of[len(fa) :]
            begin = np.append(0, np.cumsum(size))
            for i in range(len(row)):
                at = of[begin[i] : begin[i + 1]]
                at = at[at < len(fa)]
                n = int(size[i])
                own = n - len(at)
                first = n - _ceil(n, percent) + 1 - own
                if first > 0 and len(at):
                    at = at[np.lexsort((name[at], df[at]))]
                    out["row"].append(int(row[i]))
                    out["n"].append(n)
                    out["own"].append(own)
                    sig = np.array(_signature(fa[at], fb[at]), "u8").view("i8")
                    out["sig_a"].append(int(sig[0]))
                    out["sig_b"].append(int(sig[1]))
                    out["prefix"].append(name[at[:first]].view("i8"))
                    out["grams"].append(np.sort(name[at]).view("i8"))
        kinds = {c: pa.list_(pa.int64()) if c in ("prefix", "grams") else pa.int64() for c in out}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return run


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for pairs (a, b): the fragments count what two sets share, the counts are summed."""
    left = segments.select(F.col("row").alias("a"), "f", F.col("n").alias("na"), F.col("part").alias("pa"))
    right = segments.select(F.col("row").alias("b"), "f", F.col("n").alias("nb"), F.col("part").alias("pb"))
    part = pairs.join(left, "a").join(right, ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("o"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.select("a", "b", _linked("na", "nb", "o", percent).alias("linked"))


def _linked(na: str, nb: str, o: str, percent: int):
    return F.col(o) * 100 >= F.lit(percent) * (F.col(na) + F.col(nb) - F.col(o))


def _fits(a: str, b: str, percent: int):
    """Sets of these sizes can reach the threshold."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _differences(tested: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(centre, row, linked, load, size, c, least, m, diff) for clusters with a document that is not linked to the centre.
    load: percent * n + (100 + percent) * |D|; two documents link only if they share at least
    (load x + load y) / (100 + percent) - |C| differences.  least, m: the smallest load of the cluster, and whose it is.
    diff: additions, then what is missing, each in hash order."""
    open_ = tested.groupBy("b").agg(F.min("linked").alias("all")).where(~F.col("all")).select("b")
    mine = known.select(F.col("row").alias("a"), "n", F.col("grams").alias("ga"))
    centre = known.select(F.col("row").alias("b"), F.col("grams").alias("gc"), F.col("n").alias("nc"))
    rows = tested.join(open_, "b", "left_semi").join(mine, "a").join(centre, "b")
    rows = rows.select(F.col("b").alias("centre"), F.col("a").alias("row"), "linked", "n", "nc", F.array_except("gc", "ga").alias("d"), F.array_except("ga", "gc").alias("added"), F.size("gc").cast("long").alias("c"))
    rows = rows.select("centre", "row", "linked", (F.col("n") * percent + F.size("d") * (100 + percent)).alias("load"), (F.col("nc") * percent).alias("centre_load"), (F.size("d") + F.size("added")).alias("size"), "c", F.concat(F.array_sort("added"), F.array_sort("d")).alias("diff"))
    rows = stored(rows, "differences")
    low = rows.groupBy("centre").agg(F.least(F.min(F.struct("load", "row")), F.min(F.struct(F.col("centre_load").alias("load"), F.col("centre").alias("row")))).alias("low"))
    return rows.join(low, "centre").select("centre", "row", "linked", "load", "size", "c", F.col("low.load").alias("least"), F.col("low.row").alias("m"), "diff")


def _sure(percent: int):
    """Documents that link with the one of the least load, whatever their differences are."""
    return (F.col("row") != F.col("m")) & (F.col("load") + F.col("least") <= F.col("c") * (100 + percent))


def _cluster_pairs(diffs: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of one cluster, one of them not surely linked, whose differences can be shared enough."""
    whole = 100 + percent
    # the least that a document must share with one that is not surely linked, and such a one with any
    least = F.greatest(F.lit(1), F.ceil((F.col("load") - F.col("least")) / whole))
    need = F.greatest(F.lit(1), F.ceil((F.col("load") + F.col("least") - F.col("c") * whole) / whole))
    first = lambda k: F.slice("diff", F.lit(1), F.greatest(F.lit(0), F.col("size") - k + 1).cast("int"))
    x = diffs.select("centre", "c", F.col("row").alias("b"), F.col("component").alias("cb"), F.col("load").alias("lb"), F.col("size").alias("sb"), F.explode(first(least)).alias("e"))
    y = diffs.where(~_sure(percent)).select("centre", F.col("row").alias("a"), F.col("component").alias("ca"), F.col("load").alias("la"), F.col("size").alias("sa"), F.explode(first(need)).alias("e"))
    can = F.col("la") + F.col("lb") - F.col("c") * whole <= F.least("sa", "sb") * whole
    return y.join(x, ["centre", "e"]).where((F.col("a") != F.col("b")) & (F.col("ca") != F.col("cb")) & can).select("a", "b").distinct()


def _outside(posts: DataFrame, comp: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of two clusters and two components that share a prefix n-gram and can reach the threshold."""
    cluster = tested.select(F.col("a").alias("row"), F.col("b").alias("cluster"))
    placed = posts.join(comp, "row", "left").join(cluster, "row", "left")
    placed = stored(placed.select("gram", "row", "n", "left", F.coalesce("component", "row").alias("component"), F.coalesce("cluster", "row").alias("cluster")), "placed")
    each = placed.select("gram", "cluster").distinct()
    across = each.select("gram", F.col("cluster").alias("ka")).join(each.select("gram", F.col("cluster").alias("kb")), "gram").where("ka < kb")
    x = placed.select("gram", F.col("row").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("component").alias("ca"), F.col("cluster").alias("ka"))
    y = placed.select("gram", F.col("row").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("component").alias("cb"), F.col("cluster").alias("kb"))
    # of a pair's first common n-gram on, they share no more than the fewer n-grams left
    can = F.least("la", "lb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return x.join(across, ["gram", "ka"]).join(y, ["gram", "kb"]).where((F.col("ca") != F.col("cb")) & _fits("na", "nb", percent) & can).select("a", "b")


def _set_links(known: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect whatever is linked, of documents (row, n, own, prefix, grams) with different sets."""
    # a fragment of the global order: n-grams of equal leading bits
    part = lambda f: F.filter("grams", lambda g: F.call_function("shiftrightunsigned", g, F.lit(64 - PAIR_BITS)) == f)
    segments = stored(
        known.select("row", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), part(f).alias("part")) for f in range(1 << PAIR_BITS)])).alias("s")).select("row", "n", "s.f", "s.part"),
        "segments",
    )
    posts = known.select("row", "n", "own", F.posexplode("prefix").alias("k", "gram"))
    posts = stored(posts.select("row", "n", "own", "gram", (F.col("n") - F.col("own") - F.col("k")).alias("left")), "posts")

    share = F.floor(F.col("own") * 1000 / F.col("n"))
    best = posts.groupBy("gram").agg(F.min(F.struct(share.alias("share"), F.col("row").alias("b"), F.col("n").alias("nb"))).alias("c"))
    first = posts.join(best, "gram").where((F.col("row") != F.col("c.b")) & _fits("n", "c.nb", percent))
    first = first.groupBy(F.col("row").alias("a")).agg(F.min("c").alias("c")).select("a", F.col("c.b").alias("b"))
    tested = stored(_overlaps(first, segments, percent), "tested")
    diffs = _differences(tested, known, percent)
    links = tested.where("linked").select("a", "b").unionByName(diffs.where(_sure(percent)).select(F.col("row").alias("a"), F.col("m").alias("b")))
    links = stored(links, "links")
    comp = stored(components(links), "components").withColumnRenamed("id", "row")

    diffs = stored(diffs.join(comp, "row", "left").withColumn("component", F.coalesce("component", "row")), "placed-differences")
    rest = _cluster_pairs(diffs, percent).unionByName(_outside(posts.drop("own"), comp, tested, percent))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links.unionByName(_overlaps(rest, segments, percent).where("linked").select("a", "b"))


def _classified(rows: DataFrame, unique: bool, k: int, percent: int) -> DataFrame:
    """(row, doc_id, n, component_id, group) for rows (row, doc_id, text); group names the component by a row of it."""
    sets = stored(rows.mapInArrow(_signatures(k), "row long, doc_id long, n long, sig_a long, sig_b long"), "signatures")
    key = ["n", "sig_a", "sig_b"]
    classes = sets.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min(F.struct("doc_id", "row")).alias("r")).select(*key, F.col("r.row").alias("rep"), F.col("r.doc_id").alias("rep_id"))
    texts = rows.where("doc_id is not null and text is not null").select("row", "text")

    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    cut = ranges(rows, 12 * total * 2 * (100 - percent) // 100)
    near = by_bucket(texts.mapInArrow(_first_grams(k, cut, percent), _SHARED_SQL), cut).applyInArrow(_shared_rows(cut), _SHARED_SQL)
    near = by_bucket(near, cut).applyInArrow(_sum_shared, "row long, shared long")
    least = F.expr(f"(((n * {percent} + 99) div 100) * {100 - percent} + 99) div 100")
    alive = stored(near.join(classes.select(F.col("rep").alias("row"), "n"), "row").where(F.col("shared") >= least).select("row", "n"), "alive")

    cut = ranges(rows, 24 * alive.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    whole = stored(sized_join(texts, alive.select("row"), "row", "left_semi").mapInArrow(_whole_sets(k, cut), _SETS_SQL + ", run long"), "sets")
    counted = by_bucket(whole.where("bucket >= 0").select("bucket", "hash", "more", "times", "run"), cut).applyInArrow(_frequencies, _FREQUENT_SQL)
    counted = counted.withColumnRenamed("bucket", "run").groupBy("run")
    known = whole.where("bucket < 0").select("run", "row", "n", "hash", "more").groupBy("run").cogroup(counted)
    known = stored(known.applyInArrow(_prefixes(percent), "row long, n long, own long, sig_a long, sig_b long, prefix array<long>, grams array<long>"), "prefixes")

    # members of one class have equal shared n-grams and sizes; the first one stands for all
    alike = known.groupBy(*key).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("members"))
    alike = stored(alike, "alike")
    links = _set_links(known.join(alike.select(F.col("first").alias("row")), "row", "left_semi"), percent)
    comp = stored(components(links), "components")
    itself = known.select("row", "own", *key).join(alike.where("members > 1"), key).join(comp.withColumnRenamed("id", "first"), "first", "left")
    pair = F.expr(f"(n - own) * 100 >= {percent} * (n + own)")  # two members: n - own in common, n + own together
    itself = itself.where((F.col("row") != F.col("first")) & (F.col("component").isNotNull() | pair))
    comp = comp.unionByName(itself.select(F.col("row").alias("id"), F.coalesce("component", "first").alias("component")))

    placed = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(*key, "rep_id", F.coalesce("component", "rep").alias("group"))
    if unique:
        placed = placed.select(*key, "group", F.col("group").alias("component"))
    else:
        placed = placed.join(placed.groupBy("group").agg(F.min("rep_id").alias("component")), "group").drop("rep_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return sets.join(placed, key, "left").select("row", "doc_id", "n", component.alias("component_id"), "group")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: component_id is the smallest id reachable over links of
    similarity >= percent / 100 between sets of word k-grams."""
    rows, row, unique = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id")
    got = _classified(rows.select(F.col(row).alias("row"), "doc_id", "text"), unique, k, percent)
    return got.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component stays, that of the smallest id, all its columns.  Rows without words and rows of a null id
    stay; rows of equal sets are one component, so of repeated rows one stays."""
    every, row, unique = numbered(docs, "doc_id")
    got = _classified(every.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), unique, k, percent)
    if unique:
        stay = got.where("doc_id = component_id").select(F.col("row").alias(row))
    else:
        got = stored(got, "near")
        alone = "n = 0 or doc_id is null"
        stay = got.where(f"not ({alone})").groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("r")).select(F.col("r.row").alias(row))
        stay = stay.unionByName(got.where(alone).select(F.col("row").alias(row)))
    return every.join(stay, row, "left_semi").select(*docs.columns)
