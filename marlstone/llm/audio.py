"""Chroma audio fingerprints and alignment of recordings.

Method. Samples become a short-time spectrum, folded into twelve pitch classes (a
unit vector per frame). FILTERS box filters, read from the integral image of
WIDTH frames x 12 classes, compare the energy of two parts of the window; each
log ratio is quantised to two Gray-coded bits, and the bits of a frame are packed
into one 32-bit code. Windows without sound have no code.

Alignment. The filters' sign bits of codes LAGS frames apart make a word, and each of
MASKS picks KEY_BITS of its bits as a key, so that some key outlasts the errors that a link
may have (a test asks for 0.9 of the pairs that all offsets would link). Recordings are dealt by hash to blocks of about BLOCK
codes; a shuffle sends any two blocks, and each with itself, to one task, which looks up the keys of one block's recordings in the
other's sorted keys. So each recording is compared once with every other that has one of its keys, at
each offset at which they share one, and copies of one recording, however many, are spread over all tasks; what is shuffled grows with the codes times the blocks. Pairs that differ too much in the signs of a few codes (FIRST_PROBES), then in more codes (PROBES), away from the
key are left; the others link if at their best offset at least OVERLAP codes overlap with a
bit error rate up to ERRORS, counted over all their bits. Links and best alignments are
counted over all the links found. Recordings with equal codes are one class from the start;
components of links are the classes. A task passes on one row for each recording and block
and only those links that join what it has not joined yet, so rows stay linear in groups of
any size; comparisons grow with the pairs that share keys, of unrelated recordings about
the square of their number. Pairs whose overlap is little more than OVERLAP have few keys
to share and are found less often.

Edge cases: null, empty or too short audio has no codes and is a class of its own;
silence likewise; repeated rows share a class; equal votes go to the smaller
offset; an empty table gives an empty result; extra columns are ignored. Recordings are told apart by their codes: a row
without an id links as any other and gets its class, whose id is the smallest that is not null (null if there is none), and different recordings that share an id keep
their own links (their classes may then have one and the same class id). A best match without an id is null.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import mix, release, stored, table, workers_find_package
from marlstone.llm.graph import components

RATE, FRAME, HOP = 4000, 512, 128
FILTERS, WIDTH, STEP = 16, 16, 0.25
OVERLAP, ERRORS = 24, 0.25
LAGS = (0, 7, 14, 21)
TABLES, KEY_BITS = 14, 26
MASKS = tuple(sum(1 << int(b) for b in np.random.default_rng([1, i]).choice(FILTERS * len(LAGS), KEY_BITS, replace=False)) for i in range(TABLES))
FIRST_PROBES, FIRST_ERRORS, FIRST_SLACK = (-36, -18, 37, 55), 0.36, 2  # of four codes
PROBES, PROBE_ERRORS = range(-64, 64, 8), 0.3
PAD = 64  # silent codes between recordings, so that lags and probes do not leave theirs
BLOCK = 1 << 20  # codes of a block, of which a task holds one with its sorted keys
LEAST_BLOCKS = 8  # so that small tables are compared by several tasks, too
MOST_TASKS = 1 << 15
PIECE = 1 << 18  # rows of hits or codes compared at a time
GRAY = np.array([0, 1, 3, 2], np.uint32)


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames x 12 pitch-class energies, each of length 1 or, in silence, 0. ``samples`` may be a batch (rows x samples)."""
    if samples.shape[-1] < FRAME:
        return np.zeros((*samples.shape[:-1], 0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME, axis=-1)[..., ::HOP, :]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32))) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = (hertz >= 100) & (hertz <= rate * 0.45)
    pitch = 12 * np.log2(np.maximum(hertz, 1) / 440.0)
    away = np.abs((pitch[:, None] - np.arange(12) + 6) % 12 - 6)
    fold = np.where(heard[:, None], np.maximum(0, 1 - away), 0).astype(np.float32)  # shared by the two nearest classes
    energy = np.log1p(power @ fold)
    norm = np.sqrt((energy**2).sum(axis=-1, keepdims=True))
    return np.where(norm > 1e-3, energy / np.maximum(norm, 1e-3), 0)


def filter_boxes(i: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """The two parts (frame from, to, class from, to) that filter ``i`` compares; filters follow one rule."""
    height, wide = (12, 6, 4, 8)[i % 4], (16, 8, 12, 4)[i // 4 % 4]
    y, x = (5 * i) % (12 - height + 1), (WIDTH - wide) // 2
    a, b, c, d, half, mid = x, x + wide, y, y + height, x + wide // 2, y + height // 2
    kind = i % 3
    if kind == 0:  # earlier against later
        return [(a, half, c, d)], [(half, b, c, d)]
    if kind == 1:  # lower against higher
        return [(a, b, c, mid)], [(a, b, mid, d)]
    return [(a, half, c, mid), (half, b, mid, d)], [(a, half, mid, d), (half, b, c, mid)]  # crosswise


def codes(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes of a (rows x) frames x 12 image, and whether each has sound."""
    n = image.shape[-2] - WIDTH + 1
    if n < 1:
        return np.zeros((*image.shape[:-2], 0), np.uint32), np.zeros((*image.shape[:-2], 0), bool)
    total = np.zeros((*image.shape[:-2], image.shape[-2] + 1, 13))
    total[..., 1:, 1:] = image.cumsum(axis=-2).cumsum(axis=-1)

    def mean(boxes: list) -> np.ndarray:
        t = lambda x, y: total[..., x : x + n, y]
        area = sum((b - a) * (d - c) for a, b, c, d in boxes)
        return sum(t(b, d) - t(a, d) - t(b, c) + t(a, c) for a, b, c, d in boxes) / area

    packed = np.zeros((*image.shape[:-2], n), np.uint32)
    for i in range(FILTERS):
        one, other = filter_boxes(i)
        ratio = np.log((0.01 + mean(one)) / (0.01 + mean(other)))
        level = (ratio > -STEP).astype(int) + (ratio > 0) + (ratio > STEP)
        packed |= GRAY[level] << np.uint32(2 * i)
    return packed, mean([(0, WIDTH, 0, 12)]) > 0.05


def fingerprints(rows: DataFrame, samples: Callable[[list], list[np.ndarray]] | None = None, batch: int = 64) -> DataFrame:
    """(id, n_frames, codes array<int>, sound array<boolean>) of (id, audio); ``samples`` turns a list of values into
    arrays of samples (default: 16-bit little-endian PCM at RATE)."""
    workers_find_package(rows.sparkSession)
    read = samples or (lambda values: [np.frombuffer(v or b"", "<i2").astype(np.float32) / 32768 for v in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, batch):
                part = whole.slice(s, batch)
                sound = read(part.column(1).to_pylist())
                out: list = [None] * part.num_rows
                sizes: dict[int, list[int]] = {}
                for i, x in enumerate(sound):
                    sizes.setdefault(len(x), []).append(i)
                for places in sizes.values():  # recordings of one length together
                    image = chroma(np.stack([sound[i] for i in places]))
                    packed, heard = codes(image)
                    for i, c, h in zip(places, packed, heard, strict=True):
                        out[i] = (image.shape[-2], c.view(np.int32), h, zlib.crc32(c.astype("<u4")))
                names = ["id", "n_frames", "codes", "sound", "crc"]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int64()))]], names)

    return rows.mapInArrow(run, "id long, n_frames int, codes array<int>, sound array<boolean>, crc long")


class Laid:
    """Recordings end to end, PAD silent codes before and after each, and the words that keys are picked from."""

    def __init__(self, ids: np.ndarray, lists: pa.Array, sound: pa.Array) -> None:
        self.ids, self.size = ids, np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(self.size)
        self.start = PAD + ends - self.size + PAD * np.arange(len(ids))
        n = int(self.size.sum() + PAD * (len(ids) + 1))
        at = np.repeat(self.start - (ends - self.size), self.size) + np.arange(int(self.size.sum()))
        self.codes, self.heard, self.owner = np.zeros(n, np.uint32), np.zeros(n, bool), np.zeros(n, np.int32)
        self.codes[at] = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
        self.heard[at] = sound.flatten().to_numpy(zero_copy_only=False)
        self.owner[at] = np.repeat(np.arange(len(ids)), self.size)
        sign = (self.codes >> np.uint32(1)) & np.uint32(0x55555555)  # the upper Gray bit is the filter's sign
        for shift, kept in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
            sign = (sign | (sign >> np.uint32(shift))) & np.uint32(kept)
        self.signs = np.zeros(n, np.uint64)  # of codes FIRST_PROBES away, 15 bits each, and above them which have sound: all read at once
        for k, lag in enumerate(FIRST_PROBES):
            low, high = max(0, -lag), min(n, n - lag)
            there = (sign[low + lag : high + lag] & np.uint32(0x7FFF)).astype(np.uint64) << np.uint64(15 * k)
            self.signs[low:high] |= there | self.heard[low + lag : high + lag].astype(np.uint64) << np.uint64(60 + k)
        reach = n - LAGS[-1]
        self.at = np.flatnonzero(np.logical_and.reduce([self.heard[lag : lag + reach] for lag in LAGS]))
        self.words = np.zeros(len(self.at), np.uint64)
        for i, lag in enumerate(LAGS):
            self.words |= sign[self.at + lag].astype(np.uint64) << np.uint64(FILTERS * i)

    def tables(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each mask, hashed keys in ascending order and their places; a key and its place are sorted as one number."""
        bits = np.uint64(len(self.codes).bit_length())
        for mask in MASKS:
            both = np.sort(mix(self.words & np.uint64(mask)) >> bits << bits | self.at.astype(np.uint64))
            yield both >> bits, (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def ragged(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each element is of, and the elements, of the ranges [first, first + count)."""
    own = np.repeat(np.arange(len(count)), count)
    return own, np.arange(len(own)) + (first - (np.cumsum(count) - count))[own]


def pieces(count: np.ndarray) -> Iterator[slice]:
    """Runs of ``count`` that add up to about PIECE."""
    total = np.cumsum(count)
    s = 0
    while s < len(count):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + PIECE, "right")))
        yield slice(s, e)
        s = e


#: For each set of probes that have sound on both sides: their bits, and how many of these may differ.
_BITS = np.array([sum(0x7FFF << 15 * k for k in range(4) if h >> k & 1) for h in range(16)], np.uint64)
_MOST = np.array([FIRST_ERRORS * 15 * h.bit_count() + FIRST_SLACK for h in range(16)])


def probed(mine: Laid, block: Laid, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the places x and y whose codes differ little enough, by sign, FIRST_PROBES away, and by all bits PROBES away."""
    a, b = mine.signs[x], block.signs[y]
    sound = ((a & b) >> np.uint64(60)).astype(np.int64)
    good = np.flatnonzero(np.bitwise_count((a ^ b) & _BITS[sound]) <= _MOST[sound])
    x, y = x[good], y[good]
    wrong, bits = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32)
    for lag in PROBES:
        both = mine.heard[x + lag] & block.heard[y + lag]
        wrong += np.where(both, np.bitwise_count(mine.codes[x + lag] ^ block.codes[y + lag]), 0)
        bits += both
    good = wrong <= PROBE_ERRORS * 2 * FILTERS * bits
    return x[good], y[good]


def candidates(mine: Laid, block: Laid, tables: list[tuple[np.ndarray, np.ndarray]], same: bool) -> np.ndarray:
    """Distinct rows (recording, other, offset) of pairs that share a key at the offset and pass the probes; within
    the ``same`` block only others of smaller id."""
    out = []
    reach = int(block.size.max(initial=0))  # offsets lie from -reach to the longest of mine; a row is one number
    span = reach + int(mine.size.max(initial=0)) + 1
    shift = np.uint64(max(len(mine.codes).bit_length(), len(block.codes).bit_length()))
    own_shift, block_shift = (shift - np.uint64(len(z.codes).bit_length()) for z in (mine, block))  # hashes are compared by as many bits as both have
    for (keys, places), (wanted, own_places) in zip(tables, mine.tables(), strict=True):
        keys, wanted = keys >> block_shift, wanted >> own_shift
        if not len(keys):
            continue
        low = np.searchsorted(keys, wanted, "left")
        hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == wanted)
        own_places, low, wanted = own_places[hit], low[hit], wanted[hit]
        count = np.searchsorted(keys, wanted, "right") - low
        for run in pieces(count):
            own, element = ragged(low[run], count[run])
            x, y = own_places[run][own], places[element]
            if same:
                other = mine.ids[mine.owner[x]] > block.ids[block.owner[y]]
                x, y = x[other], y[other]
            x, y = probed(mine, block, x, y)
            i, j = mine.owner[x], block.owner[y]
            out.append(np.unique((i.astype(np.int64) * len(block.ids) + j) * span + (x - mine.start[i]) - (y - block.start[j]) + reach))
    found = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    pair = found // span
    return np.stack([pair // len(block.ids), pair % len(block.ids), found % span - reach], axis=1)


def alignments(mine: Laid, block: Laid, found: np.ndarray, errors: float, overlap: int) -> np.ndarray:
    """Rows (recording, other, offset, bit_errors, bits) of those ``found`` that link, at the best offset of each pair."""
    i, j, offset = found.T
    start = np.maximum(0, offset)
    length = np.minimum(mine.size[i] - start, block.size[j] - (start - offset))
    fits = length >= overlap
    i, j, offset, start, length = i[fits], j[fits], offset[fits], start[fits], length[fits]
    wrong, bits = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for run in pieces(length):
        own, x = ragged((mine.start[i] + start)[run], length[run])
        y = x + (block.start[j] - offset - mine.start[i])[run][own]
        both = mine.heard[x] & block.heard[y]
        wrong[run] = np.bincount(own, np.where(both, np.bitwise_count(mine.codes[x] ^ block.codes[y]), 0), len(length[run])).astype(np.int64)
        bits[run] = np.bincount(own, both, len(length[run])).astype(np.int64) * 2 * FILTERS
    good = (bits >= overlap * 2 * FILTERS) & (wrong <= errors * bits)
    rows = np.stack([i, j, offset, wrong, bits], axis=1)[good]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 3] / np.maximum(rows[:, 4], 1), rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))[: len(rows)]]


LINKED = "id long, n_links long, other long, offset int, bit_errors int, bits int"
NAMES = [f.split()[0] for f in LINKED.split(", ")]


class Best:
    """Links and best alignment (least rate of errors, then smallest other id) of each of n recordings."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.links = ids, np.zeros(len(ids), np.int64)
        self.rate, self.found = np.full(len(ids), np.inf), np.zeros((len(ids), 4), np.int64)

    def add(self, place: np.ndarray, other: np.ndarray, offset: np.ndarray, wrong: np.ndarray, bits: np.ndarray) -> None:
        self.links += np.bincount(place, minlength=len(self.ids))
        rate = wrong / np.maximum(bits, 1)
        order = np.lexsort((other, rate, place))
        order = order[np.append(True, place[order][1:] != place[order][:-1])[: len(order)]]
        p = place[order]
        better = (rate[order] < self.rate[p]) | (rate[order] == self.rate[p]) & (other[order] < self.found[p, 0])
        p, order = p[better], order[better]
        self.rate[p], self.found[p] = rate[order], np.stack([other, offset, wrong, bits], axis=1)[order]

    def batch(self, names: list[str]) -> pa.RecordBatch:
        linked = np.flatnonzero(self.links)
        columns = [self.ids[linked], self.links[linked], self.found[linked, 0], *(self.found[linked, k].astype(np.int32) for k in (1, 2, 3))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def dealt(prints: DataFrame) -> DataFrame:
    """``prints`` (id, codes, sound) dealt to tasks: any two blocks x <= y of recordings, and each block with itself, meet in one
    task, where the rows of y come first."""
    total = prints.agg(F.sum(F.size("codes"))).first()[0] or 0
    blocks = max(-(-total // BLOCK), LEAST_BLOCKS)
    numbered = prints.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    meeting = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")))
    rows = numbered.withColumn("m", F.explode(meeting)).select("m.x", "m.y", "block", "id", "codes", "sound")
    tasks = min(blocks * (blocks + 1) // 2, MOST_TASKS)
    number = F.pmod(F.expr("y * (y + 1) div 2 + x"), F.lit(tasks)).cast("int")
    return rows.repartitionById(tasks, number).sortWithinPartitions("x", "y", F.desc("block"))


class Meeting:
    """Recordings of two blocks, or of one: links by recording, and those that join what is not joined yet."""

    def __init__(self, held: list[pa.RecordBatch], errors: float, overlap: int) -> None:
        whole = pa.Table.from_batches(held).combine_chunks()
        self.rows, self.errors, self.overlap = whole.to_batches()[0], errors, overlap
        self.block = self.laid(self.rows)
        self.tables, self.theirs = list(self.block.tables()), Best(self.block.ids)
        self.parent: dict[int, int] = {}

    @staticmethod
    def laid(rows: pa.RecordBatch) -> Laid:
        return Laid(rows.column(3).to_numpy(), rows.column(4), rows.column(5))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent.setdefault(i, i) != i:
            parent[i] = i = parent[parent[i]]
        return i

    def compared(self, rows: pa.RecordBatch, same: bool, group: int) -> Iterator[pa.RecordBatch]:
        for s in range(0, rows.num_rows, group):
            mine = self.laid(rows.slice(s, group))
            i, j, offset, wrong, bits = alignments(mine, self.block, candidates(mine, self.block, self.tables, same), self.errors, self.overlap).T
            a, b = mine.ids[i], self.block.ids[j]
            ours = Best(mine.ids)
            ours.add(i, b, offset, wrong, bits)
            self.theirs.add(j, a, -offset, wrong, bits)
            yield ours.batch(NAMES)
            joins = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = self.root(x), self.root(y)
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
                    joins.append((x, y))
            none = pa.nulls(len(joins), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in joins], pa.int64()), pa.array([0] * len(joins), pa.int64()), pa.array([y for _, y in joins], pa.int64()), none, none, none], NAMES)


def aligned(prints: DataFrame, errors: float = ERRORS, overlap: int = OVERLAP, group: int = 256) -> tuple[DataFrame, DataFrame]:
    """Of (id, codes, sound) with distinct ids that are not null: links (a, b) that join all linked recordings into components, and
    (id, n_links, best_match, best_offset, bit_errors, bits) of each recording that has links, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, meeting = [], None, None

        def ended() -> Iterator[pa.RecordBatch]:
            """The meeting that is on, or the one of a block with itself whose rows are held, ends."""
            if now is None:
                return
            if now[0] == now[1]:
                alone = Meeting(held, errors, overlap)
                yield from alone.compared(alone.rows, True, group)
                yield alone.theirs.batch(NAMES)
            elif meeting is not None:
                yield meeting.theirs.batch(NAMES)

        for batch in batches:
            x, y, block = (batch.column(c).to_numpy() for c in range(3))
            cut = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (block[1:] != block[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if (int(x[s]), int(y[s])) != now:
                    yield from ended()
                    held, now, meeting = [], (int(x[s]), int(y[s])), None
                part = batch.slice(s, e - s)
                if int(block[s]) == now[1]:
                    held.append(part)
                elif held:  # none of y: nothing to meet
                    meeting = meeting or Meeting(held, errors, overlap)
                    yield from meeting.compared(part, False, group)
        yield from ended()

    rows = stored(dealt(prints).mapInArrow(run, LINKED))
    joins = rows.where("n_links = 0").select(F.col("id").alias("a"), F.col("other").alias("b"))
    first = F.min(F.when(F.col("n_links") > 0, F.struct((F.col("bit_errors") / F.col("bits")).alias("rate"), "other", "offset", "bit_errors", "bits")))
    best = rows.where("n_links > 0").groupBy("id").agg(F.sum("n_links").alias("n_links"), first.alias("x"))
    return joins, best.select("id", "n_links", F.col("x.other").alias("best_match"), F.col("x.offset").alias("best_offset"), "x.bit_errors", "x.bits")


def recordings(rows: DataFrame, samples: Callable | None = None) -> DataFrame:
    """A row for each recording: its fingerprint's size and checksum, class, links and best alignment."""
    key = F.when(F.exists("sound", lambda s: s), F.sha2(F.concat_ws(",", F.col("codes").cast("array<string>")), 256))
    prints = stored(fingerprints(rows, samples).withColumn("same", key))
    keyed = stored(prints.select("id", "n_frames", F.size("codes").alias("n_codes"), "crc", "same"))
    nodes = prints.where("same is not null").groupBy("same").agg(F.min("id").alias("exact_id"), F.first(F.struct("codes", "sound")).alias("first"))
    nodes = nodes.repartitionByRange("exact_id", "same").sortWithinPartitions("exact_id", "same")  # numbers in the order of ids
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "same", "exact_id", "first.codes", "first.sound"))
    release(prints)
    joins, best = aligned(nodes.select(F.col("node").alias("id"), "codes", "sound"))
    parts = components(joins).withColumnRenamed("id", "node")
    named = nodes.select("node", "same", "exact_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("exact_id").alias("class_id"))
    match = nodes.select(F.col("node").alias("best_match"), F.col("exact_id").alias("match_id"))
    best = best.join(match, "best_match").select(F.col("id").alias("node"), "n_links", F.col("match_id").alias("best_match"), "best_offset", "bit_errors", "bits")
    named = stored(named.join(least, "component").join(best, "node", "left").select("same", "exact_id", "class_id", "n_links", "best_match", "best_offset", "bit_errors", "bits"))
    release(nodes)
    out = keyed.join(named, "same", "left")
    silent = F.col("same").isNull()
    own = lambda c: F.when(silent, F.col("id")).otherwise(F.col(c)).alias(c)
    return out.select("id", "n_frames", "n_codes", "crc", own("exact_id"), own("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "best_match", "best_offset", "bit_errors", "bits")


NOTE, LEADS = 256, 5


def melody(values: list) -> list[np.ndarray]:
    """Samples of (id, vector): a note for each number, its pitch rising with the number over two
    octaves, after a rest of id % LEADS notes."""
    out = []
    for v in values:
        x = np.nan_to_num(np.asarray(v["embedding"] if v["embedding"] is not None else [], float))
        if not len(x):
            out.append(np.zeros(0, np.float32))
            continue
        unit = x / (np.sqrt((x * x).mean()) or 1)
        hertz = 330.0 * 2 ** ((np.clip(unit, -3, 3) + 3) / 3)
        phase = 2 * np.pi * np.cumsum(np.repeat(hertz, NOTE)) / RATE
        sound = 0.6 * np.sin(phase) + 0.2 * np.sin(2 * phase)
        out.append(np.concatenate((np.zeros(NOTE * (v["id"] % LEADS if v["id"] is not None else 0)), sound)).astype(np.float32))
    return out


def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio; each row of ``embeddings`` is played as a melody."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.struct(F.col("vec_id").alias("id"), "embedding").alias("audio"))
    return recordings(rows, melody).withColumnRenamed("id", "vec_id")
