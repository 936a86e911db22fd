"""Benchmark decontamination on templates.

Numbers, names and units become typed placeholders, so that a question with other parameters has the same template.
Windows of template tokens are hashed and joined with the benchmark's windows; of documents only windows that a bitmap of
the benchmark's lets pass take part, so one pass over the documents does for a benchmark of any size. Pairs of a document
and an item that share a window are then compared: matched windows of one alignment must fill the placeholders consistently (equal values stay equal, different ones different), which catches
re-parameterised questions and leaves chance matches of templates alone. Windows of plain lower-cased tokens find
verbatim copies whatever their length, place in a sentence, or share of names and numbers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spatialcc.llm.common import BROADCAST_ROWS, fresh, land, remove, sized, text_or_empty, work_dir
from spatialcc.llm.wordhash import SLICE, bounded_hashes, buffers, mixed, windows, word_bounds

#: Template tokens of a window; a shorter item is one window of its own length.
WINDOW = 8
#: Templates with fewer tokens than this can't be told from chance; items with fewer plain tokens must occur whole and exactly.
LEAST = 4
#: Share of an item's tokens, or else number of tokens, that a document must cover to count as contaminated.
COVER_SHARE, COVER_TOKENS = 0.5, 25
#: Log2 of the bits that tell which windows the benchmark has, two for each: 4 MB, whatever the benchmark; and of their parts.
BITMAP_BITS, PART_BITS = 25, 8
#: Items that are compared with a document at once.
TOGETHER = 256
#: Bytes of item texts up to which they are broadcast.
BROADCAST_BYTES = 8_000_000

# Units, where they follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yards mile miles mg g kg t lb lbs oz gram grams kilogram kilograms ton tons ml cl l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kmh percent pct degree degrees c f k "
    "usd eur gbp dollar dollars euro euros cent cents pound pounds"
).split()

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[[ord("."), ord(",")]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord("!"), ord("?"), 10]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
#: Token kinds.
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
_HOLDER = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _solid(piece: np.ndarray) -> np.ndarray:
    """Letters, digits, and a point or comma between two digits."""
    digit = _DIGIT[piece]
    solid = _LETTER[piece] | digit
    if len(piece) > 2:
        solid[1:-1] |= _POINT[piece[1:-1]] & digit[:-2] & digit[2:]
    return solid


def _unit_hashes() -> np.ndarray:
    data, at = buffers(pa.array(UNITS, pa.large_string()))
    return np.unique(bounded_hashes(data, at[:-1], at[1:]))


_UNITS = _unit_hashes()


def _characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of tokens with each Chinese or Japanese character as a token of its own, without their punctuation."""
    lo, hi = int(starts[0]), int(ends[-1])
    lead = np.flatnonzero(data[lo:hi] >= 0xE3) + lo
    if not len(lead):
        return starts, ends
    first, second, third = data[lead], data[np.minimum(lead + 1, hi - 1)], data[np.minimum(lead + 2, hi - 1)]
    wide = (first <= 0xE9) | ((first == 0xEF) & (((second >= 0xA4) & (second <= 0xAB)) | (second >= 0xBC))) | ((first == 0xF0) & (second >= 0xA0))
    marks = (first == 0xE3) & (second == 0x80) & ((third <= 0x84) | (third >= 0x88))
    marks |= (first == 0xEF) & (second == 0xBC) & ((third <= 0x8F) | ((third >= 0x9A) & (third <= 0xA0)) | (third >= 0xBB))
    marks |= (first == 0xEF) & (second == 0xBD) & ((third == 0x80) | ((third >= 0x9B) & (third <= 0xA5)))
    at = lead[wide]
    cuts = np.unique(np.concatenate([at, at + np.where(data[at] == 0xF0, 4, 3)]))
    k = np.searchsorted(starts, cuts, "left") - 1
    cuts = cuts[(k >= 0) & (cuts < ends[np.maximum(k, 0)])]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    keep = ~np.isin(starts, lead[wide & marks])
    return starts[keep], ends[keep]


@dataclass
class Templates:
    """Tokens of some texts: what a window sees, the values that fill placeholders, kinds, and the first token of each text.

    plain: the tokens in lower case, without placeholders; plain_first: the first of each text; of: the first plain
    token of each template token, and the number of plain tokens; starts, ends: bounds of plain tokens.
    """

    seen: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    plain: np.ndarray
    plain_first: np.ndarray
    of: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def templates(data: np.ndarray, at: np.ndarray) -> Templates:
    """Canonical tokens of texts.

    A token that begins with a digit is a number; a listed unit right after a number is a unit; a run of capitalised
    words that doesn't open a sentence or the text is one name. All else is a word, in lower case; each Chinese or
    Japanese character is one.
    """
    bounds = [b[:2] for b in word_bounds(data, at, _solid)]
    starts = np.concatenate([b[0] for b in bounds]) if bounds else np.zeros(0, np.int64)
    ends = np.concatenate([b[1] for b in bounds]) if bounds else np.zeros(0, np.int64)
    if len(starts):
        starts, ends = _characters(data, starts, ends)
    if not len(starts):
        none, zeros = np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        return Templates(none.astype(np.uint64), none.astype(np.uint64), none.astype(np.int8), zeros, none.astype(np.uint64), zeros, zeros[:1], none, none)
    plain = bounded_hashes(data, starts, ends)
    text = np.searchsorted(at, starts, side="right") - 1
    plain_first = np.searchsorted(text, np.arange(len(at)))
    opens = np.append(True, text[1:] != text[:-1])
    lo = int(at[0])
    stops = np.concatenate([[0], np.cumsum(_STOP[data[lo : int(at[-1])]], dtype=np.int64)])
    gap_from = np.append(starts[0], ends[:-1])
    sentence = opens | (stops[starts - lo] > stops[np.minimum(gap_from, starts) - lo])
    kind = np.zeros(len(starts), np.int8)
    kind[_DIGIT[data[starts]]] = NUMBER
    after_number = np.append(False, kind[:-1] == NUMBER) & ~opens
    kind[after_number & (kind == WORD) & np.isin(plain, _UNITS)] = UNIT
    kind[_CAPITAL[data[starts]] & ~sentence & (kind == WORD)] = NAME
    joined = np.append(False, (kind[1:] == NAME) & (kind[:-1] == NAME)) & ~opens & ~sentence
    keep = np.flatnonzero(~joined)
    value = np.add.reduceat(plain, keep)
    kind, text = kind[keep], text[keep]
    seen = np.where(kind == WORD, value, _HOLDER[kind])
    return Templates(seen, value, kind, np.searchsorted(text, np.arange(len(at))), plain, plain_first, np.append(keep, len(starts)), starts, ends)


def _exact(data: np.ndarray, a: int, b: int) -> bytes:
    """Bytes a to b in lower case, with one space for each run of blanks."""
    return b" ".join(data[a:b].tobytes().lower().split())


@dataclass
class Item:
    """An item's template tokens and plain tokens; the whole text if it has too few tokens for a window to tell them from chance."""

    id: int
    value: np.ndarray
    kind: np.ndarray
    of: np.ndarray
    plain: int
    opener: int
    exact: bytes | None


@dataclass
class Index:
    """Benchmark windows by hash, for each window size: of templates, of templates whose first word a document has inside a sentence, of plain tokens."""

    items: list[Item]
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    inside: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    plain: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _sorted_entries(found: dict[int, list[tuple[int, int, int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, owner, place) entries of each size as arrays, by hash."""
    out = {}
    for size, entries in found.items():
        if not entries:
            continue
        entries.sort()
        out[size] = (np.array([e[0] for e in entries], np.uint64), np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries], np.int64))
    return out


def benchmark_index(rows: list[tuple[int, str]], window: int = WINDOW) -> Index:
    """The index of (item_id, text) rows.

    Every item has windows of plain tokens, whatever its length. Template windows that are mostly placeholders are left
    out, as are those of items with under LEAST template tokens: only the plain windows can tell them from chance.
    """
    items, found, inside, plain = [], defaultdict(list), defaultdict(list), defaultdict(list)
    for item, text in dict.fromkeys(rows):
        data, at = buffers(pa.array([text or ""], pa.large_string()))
        t = templates(data, at)
        if not len(t.plain):
            continue
        k, n = len(items), len(t.seen)
        exact = _exact(data, t.starts[0], t.ends[-1]) if len(t.plain) < LEAST else None
        items.append(Item(item, t.value, t.kind, t.of, len(t.plain), int(t.plain[0]), exact))
        size = min(window, len(t.plain))
        plain[size] += [(int(h), k, p) for p, h in enumerate(windows(t.plain, size))]
        if n < LEAST:
            continue
        size = min(window, n)
        hashes = windows(t.seen, size)
        literal = np.convolve(t.kind == WORD, np.ones(size, int), "valid")
        found[size] += [(int(hashes[p]), k, int(p)) for p in np.flatnonzero(2 * literal >= size)]
        joined = int(t.kind[1] == NAME)  # inside a sentence the opening word is one name with a name after it
        if t.kind[0] == WORD and n - joined >= LEAST:
            size = min(window, n - joined)
            if 2 * (1 + int((t.kind[1 : size + joined] == WORD).sum())) >= size:
                seen = np.append(_HOLDER[NAME], t.seen[1 + joined : size + joined])
                inside[size].append((int(windows(seen, size)[0]), k, joined))
    return Index(items, _sorted_entries(found), _sorted_entries(inside), _sorted_entries(plain))


def _lookup(by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], tokens: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, texts, positions, owners, places) of the windows that are indexed."""
    for size, (hashes, owners, places) in by_size.items():
        own = windows(tokens, size)
        if not len(own):
            continue
        lo = np.searchsorted(hashes, own, "left")
        p = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == own)
        text = np.searchsorted(first, p, "right") - 1
        fits = p + size <= first[text + 1]
        p, text = p[fits], text[fits]
        lo = lo[p]
        many = np.searchsorted(hashes, own[p], "right") - lo
        k = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum())) if len(p) else lo
        yield size, np.repeat(text, many), np.repeat(p, many), owners[k], places[k]


def _agreed(item: Item, t: Templates, spans: set[tuple[int, int]], other: dict[int, int], shift: int) -> Iterator[tuple[int, int, bool]]:
    """The windows (a, b, changed) of one alignment that fill their placeholders consistently.

    A value's most frequent counterpart is its mapping, its own value first; windows with another one are left out. Where
    two new values are as frequent, the alignment has no mapping, and only windows without new values count.
    """
    votes: dict[tuple, tuple[int, bool]] = {}
    pair = {}
    for p in sorted({p for a, b in spans for p in range(a, b)}):
        if item.kind[p] != WORD:
            kind, x, y = int(item.kind[p]), int(item.value[p]), other[p] if p in other else int(t.value[p + shift])
            pair[p] = (kind, x, y)
            votes[kind, x, y] = (votes.get((kind, x, y), (0, False))[0] + 1, x == y)
    sides = defaultdict(list)
    for (kind, x, y), rank in votes.items():
        sides["item", kind, x].append(rank)
        sides["text", kind, y].append(rank)
    best = {side: max(ranks) for side, ranks in sides.items()}
    tied = any(ranks.count(best[side]) > 1 for side, ranks in sides.items())
    fits = {(k, x, y): not tied and rank == best["item", k, x] == best["text", k, y] for (k, x, y), rank in votes.items()}
    for a, b in spans:
        slots = {pair[p] for p in range(a, b) if p in pair}
        changed = any(x != y for _, x, y in slots)
        if not changed or all(fits[s] for s in slots):
            yield a, b, changed


def _inside_name(item: Item, t: Templates, p: int, joined: int) -> dict[int, int] | None:
    """Values of the item's second token where the name at p is the item's opening word and what joins it; None if it isn't."""
    run = t.plain[t.of[p] : t.of[p + 1]]
    at = np.flatnonzero(run[: len(run) - joined] == np.uint64(item.opener))
    if not len(at) or (not joined and at[-1] != len(run) - 1):
        return None
    return {1: int(run[at[-1] + 1 :].sum(dtype=np.uint64))} if joined else {}


def matches(index: Index, t: Templates, data: np.ndarray) -> dict[int, list[tuple[int, float, bool]]]:
    """For each text (by position) with any: items with the covered share and whether values were changed."""
    hits = defaultdict(set)  # (text, owner, shift) -> item windows
    others = {}  # of these, values of tokens that a name of the document hides
    for size, *found in _lookup(index.by_size, t.seen, t.first):
        for text, p, k, place in zip(*(x.tolist() for x in found), strict=True):
            hits[text, k, p - place].add((place, place + size))
    for size, *found in _lookup(index.inside, t.seen, t.first):
        for text, p, k, joined in zip(*(x.tolist() for x in found), strict=True):
            if (other := _inside_name(index.items[k], t, p, joined)) is not None:
                hits[text, k, p - joined].add((0, size + joined))
                others[text, k, p - joined] = other
    covered = defaultdict(lambda: (set(), set(), False))  # (text, owner) -> template tokens, plain tokens, changed
    for (text, k, shift), places in hits.items():
        item, other = index.items[k], others.get((text, k, shift), {})
        for a, b, changed in _agreed(item, t, places, other, shift):
            had, plain, was = covered[text, k]
            had.update(range(a, b))
            plain.update(range(item.of[a], item.of[b]))
            covered[text, k] = (had, plain, was or changed)
    for size, text, p, k, place in _lookup(index.plain, t.plain, t.plain_first):
        good = np.ones(len(p), bool)
        for j in range(len(p) if 1 < size < LEAST else 0):  # one token has nothing between
            good[j] = _exact(data, t.starts[p[j]], t.ends[p[j] + size - 1]) == index.items[k[j]].exact
        for x, owner, a in np.unique(np.stack([text[good], k[good], place[good]], 1), axis=0).tolist():
            covered[x, owner][1].update(range(a, a + size))
    out: dict[int, dict[int, tuple[float, bool]]] = defaultdict(dict)
    for (text, k), (had, plain, changed) in sorted(covered.items(), key=lambda x: x[0]):
        item = index.items[k]
        shares = [len(x) / n for x, n in ((had, len(item.value)), (plain, item.plain)) if len(x) >= min(COVER_SHARE * n, COVER_TOKENS)]
        if shares:
            share, was = out[text].get(item.id, (0.0, False))
            out[text][item.id] = (max(share, *shares), was or changed)
    return {text: [(i, share, changed) for i, (share, changed) in found.items()] for text, found in out.items()}


def _key(hashes: np.ndarray, size: int, plain: bool) -> np.ndarray:
    """Keys of windows, apart by size and by what they are windows of."""
    return mixed(hashes + np.uint64(2 * size + plain) * np.uint64(0x9E3779B97F4A7C15))


def _bits(keys: np.ndarray) -> np.ndarray:
    """The two bits of each key: both in the part that the key's first bits name."""
    part = (keys >> np.uint64(64 - PART_BITS)).astype(np.int64) << (BITMAP_BITS - PART_BITS)
    inner = (1 << (BITMAP_BITS - PART_BITS)) - 1
    return np.stack([part | ((keys >> np.uint64(s)).astype(np.int64) & inner) for s in (0, BITMAP_BITS - PART_BITS)])


def _item_keys(items: DataFrame) -> DataFrame:
    """(item, window, key) of the rows (item, text): all windows of an item by which it can be found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                index = benchmark_index([(item, text)])
                for plain, by_size in ((False, index.by_size), (False, index.inside), (True, index.plain)):
                    for size, (hashes, _, _) in by_size.items():
                        keys = np.unique(_key(hashes, size, plain))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), item)), pa.array(np.full(len(keys), 2 * size + plain, np.int32)), pa.array(keys.astype(np.int64))], ["item", "window", "key"])

    return items.select("item", "text").mapInArrow(run, "item bigint, window int, key bigint")


def _bitmap(keyed: DataFrame) -> np.ndarray:
    """The bits of all keys. Parts are made one after the other on the executors; 256 rows of 16 KB come to the driver."""
    size = 1 << (BITMAP_BITS - PART_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(size, bool)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])
        for batch in batches:
            parts, keys = batch.column("part").to_numpy(), batch.column("key").to_numpy().astype(np.uint64)
            cuts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(parts)], strict=True):
                if parts[lo] != now:
                    if now is not None:
                        yield row()
                    now = int(parts[lo])
                    held[:] = False
                held[_bits(keys[lo:hi]).ravel() & (size - 1)] = True
        if now is not None:
            yield row()

    dealt = keyed.select(F.shiftrightunsigned("key", 64 - PART_BITS).cast("int").alias("part"), "key").repartition("part").sortWithinPartitions("part")
    table = np.zeros((1 << PART_BITS, size // 8), np.uint8)
    for made in dealt.mapInArrow(run, "part int, bits binary").toLocalIterator():
        table[made["part"]] = np.frombuffer(made["bits"], np.uint8)
    return table.reshape(-1)


def _passing(data: np.ndarray, at: np.ndarray, table: np.ndarray, kinds: list[int]) -> list[np.ndarray]:
    """For each text the keys of its windows that the bitmap lets pass."""
    t = templates(data, at)
    texts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for kind in kinds:
        size, plain = kind >> 1, bool(kind & 1)
        tokens, first = (t.plain, t.plain_first) if plain else (t.seen, t.first)
        own = windows(tokens, size)
        if not len(own):
            continue
        own = _key(own, size, plain)
        p = np.arange(len(own))
        for bits in _bits(own):
            p = p[(table[bits[p] >> 3] >> (bits[p] & 7).astype(np.uint8)) & 1 > 0]
        text = np.searchsorted(first, p, "right") - 1
        fits = p + size <= first[text + 1]
        texts.append(text[fits])
        keys.append(own[p[fits]])
    texts, keys = np.concatenate(texts), np.concatenate(keys)
    order = np.argsort(texts, kind="stable")
    return [np.unique(part) for part in np.split(keys[order], np.searchsorted(texts[order], np.arange(1, len(at) - 1)))]


def _matched(rows: DataFrame, items: DataFrame, place: str) -> DataFrame:
    """(row, items) of the rows (row, text) that have a match, written below `place`; equal rows once."""
    spark = rows.sparkSession
    row_kind, item_kind = rows.schema["row"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    keyed = land(_item_keys(items), f"{place}/keys")
    kinds = sorted(r["window"] for r in keyed.select("window").distinct().collect())  # sizes up to WINDOW
    held = spark.sparkContext.broadcast(_bitmap(keyed))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            keys, lo = [], 0
            while lo < len(at) - 1:  # a few slices at a time
                hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + 2 * SLICE))), len(at) - 1)
                keys += _passing(data, at[lo : hi + 1], held.value, kinds)
                lo = hi
            on = pa.array([len(k) > 0 for k in keys], pa.bool_())
            found = pa.array([k.astype(np.int64) for k in keys if len(k)], pa.list_(pa.int64()))
            kept = batch.filter(on)
            yield pa.RecordBatch.from_arrays([kept.column("row"), kept.column("text"), found], ["row", "text", "keys"])

    hits = land(rows.mapInArrow(look, f"row {row_kind}, text string, keys array<bigint>"), f"{place}/hits")
    held.destroy()
    keys = keyed.select("item", "key").distinct()
    pairs = land(hits.select("row", F.explode("keys").alias("key")).join(sized(keys), "key").select("row", "item").distinct(), f"{place}/pairs")
    # Items of a document are compared with it some at a time, so none meets an unbounded number in one row.
    many = pairs.groupBy("row").agg(F.floor(F.count(F.lit(1)) / TOGETHER).alias("more"))
    split = pairs.join(many, "row").withColumn("part", F.pmod(F.xxhash64("item"), F.col("more") + 1))
    small = (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) <= BROADCAST_BYTES
    lists = split.join(F.broadcast(items) if small else items, "item").groupBy("row", "part").agg(F.collect_list(F.struct("item_id", F.col("text").alias("said"))).alias("some"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", id_kind), ("coverage", pa.float64()), ("changed", pa.bool_())]))
        for batch in batches:
            out = []
            for text, some in zip(batch.column("text"), batch.column("some").to_pylist(), strict=True):
                data, at = buffers(pa.array([text.as_py()], pa.large_string()))
                found = matches(benchmark_index([(x["item_id"], x["said"]) for x in some]), templates(data, at), data).get(0, [])
                out.append([{"item_id": i, "coverage": c, "changed": ch} for i, c, ch in found])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, kind)], ["row", "items"])

    id_kind = to_arrow_type(items.schema["item_id"].dataType)
    compared = lists.join(hits.select("row", "text"), "row").select("row", "text", "some").mapInArrow(compare, f"row {row_kind}, items array<struct<item_id:{item_kind},coverage:double,changed:boolean>>")
    found = compared.filter(F.size("items") > 0).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    found = land(found, f"{place}/found")
    for part in ("keys", "hits", "pairs"):
        remove(spark, f"{place}/{part}")
    return found


def _tables(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, str]:
    """Rows (row, text) of the documents, the distinct items (item, item_id, text), and a folder."""
    place = work_dir(docs.sparkSession, "decontamination")
    # A row is told by its id and text; rows that agree in both have the same matches.
    rows = docs.select(_row(doc_id, text).alias("row"), text_or_empty(text).alias("text"))
    items = benchmark.filter("item_id is not null").select("item_id", text_or_empty().alias("text")).distinct()
    return rows, land(items.withColumn("item", F.monotonically_increasing_id()), f"{place}/items"), place


def _row(doc_id: str, text: str):
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(text_or_empty(text)).alias("hash"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, contaminated, n_items, items, coverage, n_reparameterised.

    An item counts if aligned windows with consistent placeholders cover at least half of its template tokens, or 25 of
    them, or if these and verbatim windows cover as much of its plain tokens. Template windows that are mostly
    placeholders are left out (so such passages are found with their own values only), and an item's opening word is
    never a placeholder. A window that contradicts the alignment's most frequent mapping of values is left out alone;
    where two new values are as frequent, windows without new values still count. An item with under 4 tokens counts where its whole text occurs, but for case and the width of blanks.
    items lists the ids, ascending, joined by a comma; coverage is the largest covered share (0 without items);
    n_reparameterised counts items whose placeholders have other values. Null and empty texts match nothing, nor do
    items with a null id or without letters and digits; repeated rows of either table count each on their own (repeated items once).
    Empty tables give no matches.
    """
    rows, items, place = _tables(docs, benchmark, doc_id, text)
    found = _matched(rows, items, place).select(F.col("row").alias("_row"), "items")
    few = (found.agg(F.sum(F.size("items") + 2)).first()[0] or 0) <= BROADCAST_ROWS
    rows = rows.select("row").join(F.broadcast(found) if few else found, F.col("row") == F.col("_row"), "left")
    ids = F.array_sort(F.array_distinct(F.transform("items", lambda x: x["item_id"])))
    return rows.select(
        F.col("row.id").alias("doc_id"),
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size(ids), F.lit(0)).alias("n_items"),
        F.coalesce(F.array_join(ids.cast("array<string>"), ","), F.lit("")).alias("items"),
        F.round(F.coalesce(F.array_max(F.transform("items", lambda x: x["coverage"])), F.lit(0.0)), 6).alias("coverage"),
        F.coalesce(F.size(F.array_distinct(F.transform(F.filter("items", lambda x: x["changed"]), lambda x: x["item_id"]))), F.lit(0)).alias("n_reparameterised"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without a match, with all their columns."""
    rows, items, place = _tables(docs, benchmark, doc_id, text)
    found = _matched(rows, items, place).select(F.col("row").alias(fresh(docs, "_row")))
    own = fresh(docs, "_own")
    marked = docs.withColumn(own, _row(doc_id, text))
    return marked.join(sized(found), F.col(own) == F.col(found.columns[0]), "left_anti").drop(own)
