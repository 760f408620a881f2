"""Line dedup: MinHash over character shingles, banding, exact Jaccard, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded, components, discard, fresh, read, release, stored

#: Characters of a shingle; a shorter line is one shingle.
SHINGLE = 7
#: Least Jaccard similarity of two lines' shingle sets.
LEAST = 0.8
#: Signature: lines at the least similarity share a band with probability 1 - (1 - 0.8**5)**16 = 0.998.
BANDS, ROWS = 16, 5
#: 64-bit words of the parity map of a line's shingles, a power of two.
MAP_WORDS = 16
#: Shingles that are hashed together, lines that a task looks up before it signs one again, lines of one Arrow batch.
_STEP, _SEEN, _BATCH = 150_000, 500_000, 4_096
#: Shingles of lines that a task keeps while it verifies pairs.
_KNOWN = 400_000
#: Band hashes of a part in which shared ones are looked for, the least number of parts, and rows of one block's bucket that meet others there.
_PART, _LEAST_PARTS, _MET = 1 << 20, 256, 64
#: Bits of a band hash that tell buckets of a part apart, and bits of a line's 64-bit hash that stand beside them in one word.
_REST, _TAG = 40, 24
_RNG = np.random.default_rng(7)
_MULTIPLIERS = _RNG.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(line: str) -> str:
    """Lower case, whitespace runs as one space, none at the ends."""
    if line.isprintable() and "  " not in line:  # then single spaces are all its whitespace
        return line.strip(" ").lower()
    return " ".join(line.lower().split())


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def parity_map(line: str) -> tuple[int, np.ndarray]:
    """Number of distinct shingles, and a bitmap in which each of them flips one bit.

    Two maps differ in at most as many bits as there are shingles in only one of the lines, which bounds their similarity.
    """
    h = np.sort(_rolled(line + "\0" * max(0, SHINGLE - len(line))))
    h = h[np.concatenate(([True], h[1:] != h[:-1]))]
    bits = np.bincount(((h >> np.uint64(40)) & np.uint64(64 * MAP_WORDS - 1)).view(np.int64), minlength=64 * MAP_WORDS).astype(np.uint8) & 1
    return len(h), np.packbits(bits).view(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _rolled(text: str) -> np.ndarray:
    """A 64-bit hash of each run of ``SHINGLE`` characters."""
    codes = _codes(text).astype(np.uint64)
    h = np.zeros(len(codes) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        h *= _BASE
        h += codes[k : k + len(h)]
    h ^= h >> np.uint64(31)
    h *= _BASE
    return h


def _may_be_alike(na: str, ma: str, nb: str, mb: str, least: float) -> Column:
    """False only for pairs whose similarity is surely below ``least``, from numbers of shingles and parity maps."""
    apart = sum((F.bit_count(F.get(ma, F.lit(i)).bitwiseXOR(F.get(mb, F.lit(i)))) for i in range(MAP_WORDS)), F.lit(0))
    n = F.col(na) + F.col(nb)
    return (F.least(na, nb) >= least * F.greatest(na, nb)) & (apart <= n * ((1 - least) / (1 + least)) + 1e-6)


def band_hashes(lines: list[str]) -> np.ndarray:
    """int64 array of ``BANDS`` columns, a row for each (normal, non-empty) line."""
    out = np.zeros((len(lines), BANDS), dtype=np.uint64)
    at = 0
    while at < len(lines):
        to, size = at, 0
        while to < len(lines) and (to == at or size + len(lines[to]) < _STEP):
            size += len(lines[to])
            to += 1
        some = lines[at:to]
        pad = "\0" * (SHINGLE - 1)
        n = np.array([len(x) for x in some])
        starts = np.concatenate(([0], np.cumsum(n + SHINGLE - 1)[:-1]))
        h = (_rolled(pad.join(some) + pad) >> np.uint64(32)).astype(np.uint32)
        count = np.maximum(1, n - SHINGLE + 1)
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        h = h[np.arange(count.sum()) - np.repeat(first - starts, count)]
        least = np.empty((len(_MULTIPLIERS), len(some)), dtype=np.uint32)
        turned = np.empty_like(h)
        for k, m in enumerate(_MULTIPLIERS):
            np.multiply(h, m, out=turned)
            np.minimum.reduceat(turned, first, out=least[k])
        of = least.reshape(BANDS, ROWS, len(some))
        acc = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(some), axis=1)
        for k in range(ROWS):
            acc ^= of[:, k]
            acc *= _BASE
            acc ^= acc >> np.uint64(29)
        out[at:to] = acc.T
        at = to
    return out.view(np.int64)


def _key(text: str = "text") -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th")]


_SIGNED = pa.schema([("sid", pa.int64()), ("d", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("t", pa.string()), ("bands", pa.binary())])


def line_signatures(docs: DataFrame) -> DataFrame:
    """``(sid, d, th, line, h1, h2, t, bands)`` of every line with any character but whitespace.

    sid: a number of its own; t: the normal line; h1, h2: its 128-bit hash; bands: its band hashes as 64-bit
    words, null where the task has signed an equal line before. Store it before use: a task that runs again may number otherwise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid = TaskContext.get().partitionId() << 40
        seen: set[bytes] = set()

        def made(held: list[tuple], digests: list[bytes], lines: list[str]) -> pa.RecordBatch:
            nonlocal sid
            new = []
            for i, x in enumerate(digests):
                if x not in seen:
                    new.append(i)
                    seen.add(x)
            bands: list[bytes | None] = [None] * len(lines)
            raw = band_hashes([lines[i] for i in new]).tobytes()
            for k, i in enumerate(new):
                bands[i] = raw[8 * BANDS * k : 8 * BANDS * (k + 1)]
            if len(seen) > _SEEN:
                seen.clear()
            d, th, n = zip(*held, strict=True)
            h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            sids = np.arange(sid, sid + len(lines))
            sid += len(lines)
            return pa.RecordBatch.from_arrays([pa.array(sids), pa.array(d, pa.int64()), pa.array(th, pa.int64()), pa.array(n, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(lines, pa.string()), pa.array(bands, pa.binary())], schema=_SIGNED)

        for batch in batches:
            held, digests, lines = [], [], []
            for at in range(0, batch.num_rows, 64):
                for d, th, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    for n, line in enumerate((text or "").split("\n")):
                        if x := normal(line):
                            held.append((d, th, n))
                            digests.append(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")))
                            lines.append(x)
                    if len(lines) >= _BATCH:
                        yield made(held, digests, lines)
                        held, digests, lines = [], [], []
            if lines:
                yield made(held, digests, lines)

    return docs.select(*_key(), "text").mapInArrow(run, "sid long, d long, th long, line int, h1 long, h2 long, t string, bands binary")


def shared_buckets(signed: DataFrame) -> DataFrame:
    """``(bucket, sid)``: the band hashes that two or more different lines of ``signed(sid, h1, bands)`` have, with these lines.

    Hashes travel as sorted blocks, not as a row each: a task cuts a block of them into parts by their leading
    bits, and a part's blocks meet in one group of about ``_PART`` hashes. Equal lines of several tasks count
    once, by the smallest sid; 64 bits of their hash tell lines of a bucket apart. Of one block's bucket only
    ``_MET`` lines meet others; the rest is known to share it and passes by, so that no bucket makes a large group.
    """
    parts = max(_LEAST_PARTS, signed.count() * BANDS // _PART)
    low, rest_of_hash = np.uint64((1 << _REST) - 1), np.uint64(64 - _TAG)

    def packed(part: np.ndarray, v: np.ndarray, h: np.ndarray, sid: np.ndarray) -> pa.RecordBatch:
        """Blocks of rows that are sorted by part: the words of v, then those of h and of sid."""
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ends = np.append(first, len(v))[1:]
        blocks = [v[a:b].tobytes() + h[a:b].tobytes() + sid[a:b].tobytes() for a, b in zip(first, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int64)), pa.array(blocks, pa.binary())], names=["part", "block"])

    def cut(sid: np.ndarray, h: np.ndarray, bands: np.ndarray) -> Iterator[pa.RecordBatch]:
        b = bands.ravel()
        order = np.argsort(b)  # by part too, which is made of the leading bits
        b, row = b[order], order // BANDS
        part = ((b >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        h, sid = h[row], sid[row]
        v = ((b & low) << np.uint64(_TAG)) | (h >> rest_of_hash)
        start = np.concatenate(([True], b[1:] != b[:-1]))
        place = np.arange(len(b)) - np.flatnonzero(start)[np.cumsum(start) - 1]
        met = place < _MET
        if met.all():
            yield packed(part, v, h, sid)
            return
        yield packed(part[met], v[met], h[met], sid[met])
        past = (part[~met] << np.uint64(_REST)) | (b[~met] & low)
        to = np.sort(np.uint64(parts) + np.arange(len(past), dtype=np.uint64) % np.uint64(parts))
        yield packed(to, past, past, sid[~met])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            bands = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64).reshape(-1, BANDS)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), bands))
            n += len(bands)
            if n * BANDS >= _PART:
                yield from cut(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from cut(*map(np.concatenate, zip(*held, strict=True)))

    def met(table: pa.Table) -> pa.Table:
        part, words = table.column("part")[0].as_py(), [np.frombuffer(x, dtype=np.uint64).reshape(3, -1) for x in table.column("block").to_pylist()]
        v, h, sid = np.concatenate(words, axis=1)
        if part < parts:
            order = np.argsort(v)
            v, h, sid = v[order], h[order], sid[order]
            if ((v[1:] == v[:-1]) & (h[1:] != h[:-1])).any():  # different lines of a bucket agree in the bits that v has
                order = np.lexsort((h, v))
                v, h, sid = v[order], h[order], sid[order]
            once = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (h[1:] != h[:-1]))))
            rest, sid = v[once] >> np.uint64(_TAG), np.minimum.reduceat(sid, once)
            same = np.concatenate(([False], rest[1:] == rest[:-1], [False]))
            two = same[1:] | same[:-1]
            v, sid = (np.uint64(part) << np.uint64(_REST)) | rest[two], sid[two]
        return pa.table({"bucket": v.view(np.int64), "sid": sid.view(np.int64)})

    held = signed.where("bands is not null").select("sid", "h1", "bands").mapInArrow(blocks, "part long, block binary")
    return held.groupBy("part").applyInArrow(met, "bucket long, sid long")


def _ordered(x: Column, y: Column) -> list[Column]:
    """The ends of a pair as ``a`` and ``b``, b the one whose number has the smaller hash."""
    turned = F.xxhash64(x) < F.xxhash64(y)
    return [F.when(turned, y).otherwise(x).alias("a"), F.when(turned, x).otherwise(y).alias("b")]


def _spokes(buckets: DataFrame) -> DataFrame:
    """Stored pairs ``(a, b)``: each line of a bucket with its two leads, the lines whose numbers have the smallest and the largest hash.

    Lines that share several buckets mostly have the same leads in all of them.
    """
    rank = F.xxhash64("sid")
    lead = buckets.groupBy("bucket").agg(F.min_by("sid", rank).alias("low"), F.max_by("sid", rank).alias("high"))
    ends = buckets.join(lead, "bucket").select(F.explode(F.array(F.struct(F.col("sid").alias("a"), F.col("low").alias("b")), F.struct(F.col("high").alias("a"), F.col("sid").alias("b")))).alias("x"))
    return stored(ends.select("x.*").where("a <> b").distinct(), "spokes")


def _surely_alike(x: str, y: str, nx: int, ny: int, least: float) -> bool:
    """Whether what two lines with ``nx`` and ``ny`` shingles share at their starts and ends is already enough."""
    most = min(len(x), len(y))
    if most < SHINGLE:
        return x == y
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x.startswith(y[:mid]) else (low, mid - 1)
    start, low, high = low, 0, most - low
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x.endswith(y[len(y) - mid :]) else (low, mid - 1)
    same = max(0, start - SHINGLE + 1) + max(0, low - SHINGLE + 1)
    # of a line's different shingles at most as many are elsewhere as there are places elsewhere
    both = max(nx - (len(x) - SHINGLE + 1 - same), ny - (len(y) - SHINGLE + 1 - same))
    return both >= least * (nx + ny - both)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Stored: the pairs ``(a, b)`` whose lines' shingle sets are that similar."""
    maps = texts.select("sid", "n", "map")
    near = pairs.join(maps.toDF("a", "na", "ma"), "a").join(maps.toDF("b", "nb", "mb"), "b").where(_may_be_alike("na", "ma", "nb", "mb", least)).select("a", "b", "na", "nb")
    near = stored(near, "near")  # fewer of the pairs are left before texts are joined
    t = texts.select("sid", "t")
    both = near.join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b").select("a", "b", "ta", "tb", "na", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set[str]] = {}
        size = 0

        def of(sid: int, line: str) -> set[str]:
            nonlocal size
            if (found := known.get(sid)) is None:
                found = shingles(line)
                if size + len(found) > _KNOWN:
                    known.clear()
                    size = 0
                known[sid] = found
                size += len(found)
            return found

        for batch in batches:
            keep = []
            for a, b, x, y, nx, ny in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if _surely_alike(x, y, nx, ny, least):
                    keep.append(True)
                    continue
                p, q = of(a, x), of(b, y)
                both = len(p & q)
                keep.append(both >= least * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = stored(both.mapInArrow(run, "a long, b long"), "links")
    discard(near)
    return out


def _texts(signed: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``(sid, h1, h2, t, n, map)`` of the lines in ``nodes(sid)``, with their parity maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, maps = zip(*map(parity_map, batch.column(3).to_pylist()), strict=True) if batch.num_rows else ((), ())
            flat = np.concatenate(maps) if maps else np.zeros(0, dtype=np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(maps) + 1, dtype=np.int32) * MAP_WORDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), listed], names=["sid", "h1", "h2", "t", "n", "map"])

    held = signed.select("sid", "h1", "h2", "t").join(bounded(nodes, n, 8), "sid")
    return held.mapInArrow(run, "sid long, h1 long, h2 long, t string, n int, map array<long>")


def _across(buckets: DataFrame, comp: DataFrame, n_comp: int, texts: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of a bucket that are in different components and that counts and parity maps don't prove apart.

    Lines meet by bucket and by their number of shingles on a logarithmic scale, on which lines that may be
    alike are at most one step apart: that splits a large bucket. Each pair comes from the first bucket that it shares.
    """
    rooted = buckets.join(bounded(comp.toDF("sid", "root"), n_comp, 16), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rooted = stored(rooted, "rooted")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    met = stored(rooted.join(mixed, "bucket"), "met")
    own = met.groupBy("sid").agg(F.collect_list("bucket").alias("own_buckets"))  # as many as there are bands at most
    held = met.join(own, "sid").join(texts.select("sid", "n", "map"), "sid")
    held = stored(held.withColumn("step", F.floor(F.log("n") / float(-np.log(least))).cast("int")), "mixed")
    l = held.select("bucket", "step", F.col("sid").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("map").alias("ma"), F.col("own_buckets").alias("xa"))
    r = held.select("bucket", F.explode(F.array(F.col("step"), F.col("step") - 1)).alias("step"), F.col("step").alias("own"), F.col("sid").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("map").alias("mb"), F.col("own_buckets").alias("xb"))
    once = (F.col("own") != F.col("l.step")) | (F.col("a") < F.col("b"))
    first = F.array_min(F.array_intersect("xa", "xb")) == F.col("l.bucket")
    on = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.step") == F.col("r.step")) & (F.col("ra") != F.col("rb")) & once & _may_be_alike("na", "ma", "nb", "mb", least) & first
    out = stored(l.alias("l").join(r.alias("r"), on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "across")
    discard(rooted, met, held)
    return out


def line_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Stored ``(d, th, line, class)``: every line that has an equal or a similar one, by component.

    Equal lines are one before any pair is made. A bucket's lines are compared with a few of its lines, which
    joins a large group with pairs in proportion to its size. Then the pairs of a bucket that are still in
    different components are compared too, but for those that their parity maps prove to differ too much: no
    link of a bucket is lost. The second run of components joins whole components of the first.
    """
    signed = stored(line_signatures(docs), "signed")
    places = signed.select("sid", "d", "th", "line", "h1", "h2")
    repeated = stored(places.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min("sid").alias("sid")).where("times > 1").select("h1", "h2", "sid"), "repeated")
    buckets = stored(shared_buckets(signed), "buckets")
    nodes = stored(buckets.select("sid").distinct(), "nodes")
    texts = stored(_texts(signed, nodes, nodes.count()), "texts")
    spokes = _spokes(buckets)
    links = _verified(spokes, texts, least)
    comp = stored(components(links), "components")
    n_comp = comp.count()
    across = _across(buckets, comp, n_comp, texts, least)
    more = _verified(across.join(spokes, ["a", "b"], "left_anti"), texts, least)
    if not more.isEmpty():
        comp = _joined(comp, n_comp, more)
        n_comp = comp.count()
    found = texts.select("sid", "h1", "h2").join(bounded(comp.toDF("sid", "root"), n_comp, 16), "sid").select("h1", "h2", "root").distinct()
    keys = stored(repeated.join(found, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("root", "sid").alias("class")), "keys")
    classes = stored(places.drop("sid").join(bounded(keys, keys.count(), 24), ["h1", "h2"]).select("d", "th", "line", "class"), "classes")
    discard(signed, repeated, buckets, nodes, texts, spokes, links, across, more, comp, keys)
    release(docs.sparkSession)
    return classes


def _joined(comp: DataFrame, n: int, more: DataFrame) -> DataFrame:
    """Stored: ``comp(node, root)`` with the components that ``more(a, b)`` links made one; ends that are in none are their own."""
    root = comp.toDF("sid", "root")
    ends = more.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    alone = ends.join(root, "sid", "left_anti").select(F.col("sid").alias("node"), F.col("sid").alias("root"))
    of = stored(ends.join(bounded(root, n, 16), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root")), "ends")
    above = more.join(of.toDF("a", "ra"), "a").join(of.toDF("b", "rb"), "b").select("ra", "rb").distinct()
    above = stored(components(above, "ra", "rb"), "components").toDF("root", "top")
    out = stored(comp.union(alone).join(bounded(above, above.count(), 16), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "components")
    discard(comp, of, above)
    return out


def _dropped(docs: DataFrame, least: float) -> tuple[DataFrame, int]:
    """``(d, th, gone)``: per document the numbers of its lines that aren't their component's first; and about how many bytes these are."""
    classes = line_classes(docs, least)
    first = stored(classes.groupBy("class").agg(F.min(F.struct("d", "line", "th")).alias("first")).select("class", "first.*").toDF("class", "fd", "fline", "fth"), "first")
    other = (F.col("d") != F.col("fd")) | (F.col("line") != F.col("fline")) | (F.col("th") != F.col("fth"))
    gone = classes.join(bounded(first, first.count(), 32), "class").where(other)
    gone = stored(gone.groupBy("d", "th").agg(F.collect_set("line").alias("gone")), "dropped")
    discard(classes, first)
    n, lines = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    return gone, 40 * n + 8 * lines


def _cleaned(docs: DataFrame, least: float) -> tuple[DataFrame, str]:
    """``docs`` with the numbers of its dropped lines, in the column that is named too."""
    gone, size = _dropped(docs, least)
    d, th, name = (fresh(docs, x) for x in ("d", "th", "gone"))
    own = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) == F.col(d)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(th))
    return docs.join(bounded(gone.toDF(d, th, name), 1, size), own, "left").drop(d, th), name


def _kept(gone: str) -> Column:
    return F.expr(f"array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains({gone}, i)), '\\n')")


def deduplicated(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with one line of each component of similar lines, the first by doc_id, line number and hash of the text; n_chars follows.

    Blank lines stay. A document may lose all its lines; its row stays with an empty text. Null texts stay null.
    A null doc_id comes before any other. Rows that repeat doc_id and text are treated alike. Other columns pass
    through, whatever their names.
    """
    names = docs.columns
    held, gone = _cleaned(docs, least)
    out = held.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(_kept(gone)))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(names)


def line_report(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, and the SHA-256 of the text that is left (null: empty). Other columns are not looked at."""
    docs = docs.select("doc_id", "text")
    held, gone = _cleaned(docs, least)
    text = F.coalesce("text", F.lit(""))
    kept = F.when(F.col(gone).isNull(), text).otherwise(_kept(gone))
    return held.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_report`` of all documents; nulls, repeats and ties as there."""
    return line_report(read(spark, sf_dir, "documents"))
