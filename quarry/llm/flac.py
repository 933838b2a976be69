"""FLAC media columns: encode 8-bit samples, decode Rice residuals and linear predictors, verify checksums, give PCM blocks.

Encoding picks a fixed predictor (orders 0 to 4) and a Rice parameter for each frame; a constant frame is stored as such, and one that
gains nothing is stored verbatim. Decoding reads any mono stream of 4 to 16 bits a sample: constant, verbatim, fixed and LPC
subframes, partitioned Rice residuals of both kinds with escapes. Frames of one shape are decoded side by side, a sample of each
at a time. Header CRC-8, frame CRC-16 and the stream's MD5 are verified; a mismatch raises.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_path, table, texts

RATE, BLOCK_SAMPLES, UNIT = 8000, 4096, 64
CRC_BLOCK = 256
LANES = 256


@functools.lru_cache(1)
def crc16_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-16 of polynomial 0x8005: tables for eight bytes at a time, and for a state moved past CRC_BLOCK zero bytes."""
    one = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        one = np.where(one & 0x8000, one << 1 ^ 0x8005, one << 1) & 0xFFFF
    step = lambda s: (s << 8 & 0xFFFF) ^ one[s >> 8]
    slices = [one]
    for _ in range(7):
        slices.append(step(slices[-1]))
    move = [np.arange(256, dtype=np.uint32), np.arange(256, dtype=np.uint32) << 8]
    for i in range(2):
        for _ in range(CRC_BLOCK):
            move[i] = step(move[i])
    return np.stack(slices), np.stack(move)


def crc16(items: list[bytes]) -> list[int]:
    """CRC-16 of each byte string; blocks of all strings are read at once, and each string's blocks joined."""
    slices, move = crc16_tables()
    counts = [-(-len(x) // CRC_BLOCK) for x in items]
    blocks = np.frombuffer(b"".join(x.rjust(n * CRC_BLOCK, b"\0") for x, n in zip(items, counts, strict=True)), np.uint8).reshape(-1, CRC_BLOCK // 8, 8)
    state = np.zeros(len(blocks), np.uint32)
    for k in range(CRC_BLOCK // 8):
        b = blocks[:, k]
        state = slices[7][b[:, 0] ^ state >> 8] ^ slices[6][b[:, 1] ^ state & 255]
        for i in range(2, 8):
            state ^= slices[7 - i][b[:, i]]
    low, high = move.tolist()
    states, at, out = state.tolist(), 0, []
    for n in counts:
        s = 0
        for other in states[at : at + n]:
            s = low[s & 255] ^ high[s >> 8] ^ other
        at += n
        out.append(s)
    return out


@functools.lru_cache(1)
def crc8_table() -> list[int]:
    out = []
    for s in range(256):
        for _ in range(8):
            s = (s << 1 ^ 7 if s & 128 else s << 1) & 255
        out.append(s)
    return out


def crc8(data: bytes) -> int:
    s, t = 0, crc8_table()
    for b in data:
        s = t[s ^ b]
    return s


def utf8_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of frame headers."""
    if n < 128:
        return bytes([n])
    size = next(i for i in range(2, 8) if n < 1 << 5 * i + 1)
    tail = [128 | n >> 6 * i & 63 for i in reversed(range(size - 1))]
    return bytes([(0xFF00 >> size & 255) | n >> 6 * (size - 1), *tail])


def residual(samples: np.ndarray, order: int) -> np.ndarray:
    """What the fixed predictor of an order leaves: the order's difference, without the warm-up samples."""
    return np.diff(samples, order) if order else samples


def encode_body(samples: np.ndarray) -> bytes:
    """A subframe of 8-bit samples, filled up to whole bytes."""
    n = len(samples)
    if (samples == samples[0]).all():
        return bytes([0, samples[0] & 255])
    left, sums = samples, []
    for order in range(min(5, n)):
        sums.append(int(np.abs(left[min(4, n - 1) - order :]).sum()))
        left = np.diff(left)
    order = int(np.argmin(sums))
    left = residual(samples, order)
    zigzag = np.where(left < 0, -2 * left - 1, 2 * left)
    mean = int(zigzag.sum()) / len(zigzag)
    guess = max(0, int(mean).bit_length() - 1)
    size, k = min((int((zigzag >> k).sum()) + len(zigzag) * (1 + k), k) for k in range(max(0, guess - 1), min(14, guess + 1) + 1))
    if size + 8 * order + 10 >= 8 * n:
        return bytes([2]) + (samples & 255).astype(np.uint8).tobytes()
    lengths = (zigzag >> k) + 1 + k
    head = 8 + 8 * order + 10
    ends = np.cumsum(lengths) + head
    bits = np.zeros(-(-int(ends[-1]) // 8) * 8, np.uint8)
    bits[:8] = np.unpackbits(np.array([16 | order << 1], np.uint8))
    bits[8 : 8 + 8 * order] = np.unpackbits((samples[:order] & 255).astype(np.uint8))
    bits[head - 4 : head] = [k >> 3 & 1, k >> 2 & 1, k >> 1 & 1, k & 1]  # two bits of method and four of partition order are zero
    bits[ends - k - 1] = 1
    for j in range(k):
        bits[ends - 1 - j] = zigzag >> j & 1
    return np.packbits(bits).tobytes()


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, whose bytes are samples raised by 128. Empty payloads raise: a stream has a sample at least."""
    bodies, counts = [], []
    for data in payloads:
        samples = np.frombuffer(data, np.uint8).astype(np.int32) - 128
        frames = []
        for i, at in enumerate(range(0, len(samples), BLOCK_SAMPLES)):
            part = samples[at : at + BLOCK_SAMPLES]
            head = bytes([0xFF, 0xF8, 0x70, 0x02]) + utf8_number(i) + struct.pack(">H", len(part) - 1)
            frames.append(head + bytes([crc8(head)]) + encode_body(part))
        bodies += frames
        counts.append(len(frames))
    sums, at, out = crc16(bodies), 0, []
    for data, n in zip(payloads, counts, strict=True):
        frames = [x + struct.pack(">H", c) for x, c in zip(bodies[at : at + n], sums[at : at + n], strict=True)]
        at += n
        sizes = [len(x) for x in frames]
        signed = (np.frombuffer(data, np.uint8) ^ 128).tobytes()
        info = struct.pack(">HH", BLOCK_SAMPLES, BLOCK_SAMPLES) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(data)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        out.append(b"fLaC" + struct.pack(">I", 0x80 << 24 | len(info)) + info + b"".join(frames))
    return out


def read_stream(data: bytes) -> tuple[int, int, bytes, int]:
    """(bits a sample, samples, MD5, offset of the first frame) of a mono stream."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, last = 4, b"", False
    while not last:
        (head,) = struct.unpack_from(">I", data, at)
        last, kind, size = head >> 31, head >> 24 & 127, head & 0xFFFFFF
        if kind == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7:
        raise ValueError("only mono streams are read")
    return (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34], at


def read_header(data: bytes, at: int, bps: int) -> tuple[int, int]:
    """(samples, bytes of the header) of the frame at an offset; verifies its CRC-8."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame here")
    size_code, rate_code = data[at + 2] >> 4, data[at + 2] & 15
    end, lead = at + 5, data[at + 4]
    while lead & 0x80 and lead & 0x40:
        lead = lead << 1 & 255
        end += 1
    if size_code == 6:
        n, end = data[end] + 1, end + 1
    elif size_code == 7:
        n, end = struct.unpack_from(">H", data, end)[0] + 1, end + 2
    else:
        n = 192 if size_code == 1 else 576 << size_code - 2 if size_code < 6 else 256 << size_code - 8
    end += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(data[at:end]) != data[end]:
        raise ValueError("a frame header's checksum is wrong")
    return n, end + 1 - at


class Bits:
    """A place in a byte string, bit by bit: for subframes that aren't decoded side by side."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int, signed: bool = False) -> int:
        self.left -= n
        got = self.value >> self.left & (1 << n) - 1
        return got - (1 << n) if signed and n and got >> n - 1 else got

    def unary(self) -> int:
        rest = self.value & (1 << self.left) - 1
        n = self.left - rest.bit_length()
        self.left -= n + 1
        return n


def decode_slowly(data: bytes, n: int, bps: int) -> tuple[list[int], int]:
    """(samples, bytes used) of any subframe, and of the padding after it."""
    b = Bits(data)
    b.take(1)
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.unary() + 1
    bps -= wasted
    if kind == 0:
        out = [b.take(bps, True)] * n
    elif kind == 1:
        out = [b.take(bps, True) for _ in range(n)]
    else:
        fixed = kind < 32
        order = kind - 8 if fixed else kind - 31
        out, shift = [b.take(bps, True) for _ in range(order)], 0
        if fixed:
            weights = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
        else:
            precision = b.take(4) + 1
            shift = b.take(5, True)
            weights = [b.take(precision, True) for _ in range(order)]
        wide = 4 + b.take(2)
        parts = 1 << b.take(4)
        for p in range(parts):
            k, count = b.take(wide), n // parts - (order if p == 0 else 0)
            raw = b.take(5) if k == (1 << wide) - 1 else None
            for _ in range(count):
                if raw is None:
                    z = b.unary() << k
                    z |= b.take(k)
                    e = -(z + 1 >> 1) if z & 1 else z >> 1
                else:
                    e = b.take(raw, True)
                out.append(e + (sum(w * x for w, x in zip(weights, reversed(out), strict=False)) >> shift))
    used = 8 * len(data) - b.left
    return [x << wasted for x in out], -(-used // 8)


def next_one(bits: np.ndarray) -> np.ndarray:
    """For each place, the first place from it on where a bit is set."""
    n = len(bits)
    at = np.where(bits, np.arange(n, dtype=np.int32), np.int32(n - 1))
    return np.minimum.accumulate(at[::-1])[::-1]


def decode_lanes(bodies: list[bytes], counts: list[int]) -> list[tuple[np.ndarray, int]]:
    """(samples, bytes used) of fixed subframes of 8-bit samples with one Rice partition, a lane for each.

    The end of a code is the next set bit and its parameter's bits on; so all lanes step from code to code together.
    """
    raw = b"".join(bodies) + bytes(8)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))
    stops = next_one(bits)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    order = np.fromiter((x[0] >> 1 & 7 for x in bodies), np.int64, len(bodies))
    head = base * 8 + 8 + 8 * order + 6
    k = bits[head] * 8 + bits[head + 1] * 4 + bits[head + 2] * 2 + bits[head + 3]
    k = k.astype(np.int64)
    pos, most = head + 4, np.array(counts) - order
    steps = int(most.max())
    starts = np.zeros((steps + 1, len(bodies)), np.int64)
    top, skip = len(bits) - 1, k + 1
    for i in range(steps):
        starts[i] = pos
        pos = np.minimum(stops[pos] + skip, top)
    starts[steps] = pos
    out = []
    wide = np.frombuffer(raw, np.uint8).astype(np.uint32)
    wide = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    for lane in range(len(bodies)):
        n, o, kk = int(most[lane]), int(order[lane]), int(k[lane])
        at = starts[:n, lane]
        stop = stops[at].astype(np.int64)
        zigzag = (stop - at) << kk
        if kk:
            low = stop + 1
            zigzag |= wide[low >> 3].astype(np.int64) >> (32 - kk - (low & 7)) & (1 << kk) - 1
        left = np.where(zigzag & 1, -(zigzag + 1 >> 1), zigzag >> 1)
        first = base[lane] * 1
        warm = np.frombuffer(raw[first + 1 : first + 1 + o], np.int8).astype(np.int64)
        for d in range(o, 0, -1):
            seed = np.diff(warm, d - 1)[:1]
            left = np.cumsum(np.concatenate([seed, left]))
            # the d-th difference begins with its own warm-up value; one sum restores the difference below
        end = int(starts[n, lane]) - 8 * int(first)
        out.append((left, -(-end // 8)))
    return out


def decode(streams: list[bytes]) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """(PCM as unsigned or little-endian signed samples, blocks of (first sample, samples, offset)) of each stream.

    8-bit samples come back raised by 128, wider ones as 16-bit integers. Frames are found one after the other where their
    length isn't known, so frames of all streams advance together.
    """
    state = [(*read_stream(x),) for x in streams]
    offsets, done = [s[3] for s in state], [0] * len(streams)
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    blocks: list[list[tuple[int, int, int]]] = [[] for _ in streams]
    active = [i for i, s in enumerate(state) if s[1]]
    while active:
        fast, slow, frames, sums = [], [], [], []
        for i in active:
            n, head = read_header(streams[i], offsets[i], state[i][0])
            at = offsets[i] + head
            body = streams[i][at : at + 2 * n + 64]
            fixed = 8 <= body[0] >> 1 <= 12 and not body[0] & 1 and state[i][0] == 8
            if fixed:
                o = body[0] >> 1 & 7
                method = body[1 + o] >> 2
                k = (body[1 + o] & 3) << 2 | body[2 + o] >> 6
                fixed = method == 0 and k < 15
            (fast if fixed else slow).append((i, n, head, body))
        got = []
        fast.sort(key=lambda x: x[1])
        for j in range(0, len(fast), LANES):
            run = fast[j : j + LANES]
            got += zip(run, decode_lanes([x[3] for x in run], [x[1] for x in run]), strict=True)
        for x in slow:
            i, n, head, _ = x
            kind = x[3][0]
            bps = state[i][0]
            if kind == 2 and bps == 8:
                samples, used = np.frombuffer(x[3][1 : n + 1], np.int8).astype(np.int64), n + 1
            elif kind == 0 and bps == 8:
                samples, used = np.full(n, np.frombuffer(x[3][1:2], np.int8)[0], np.int64), 2
            else:
                rest = streams[i][offsets[i] + head : offsets[i] + head + 8 * n + 256]
                values, used = decode_slowly(rest, n, bps)
                samples = np.array(values, np.int64)
            got.append((x, (samples, used)))
        for (i, n, head, _), (samples, used) in got:
            end = offsets[i] + head + used
            frames.append(streams[i][offsets[i] : end])
            sums.append(struct.unpack_from(">H", streams[i], end)[0])
            blocks[i].append((done[i], n, offsets[i]))
            parts[i].append(samples)
            offsets[i], done[i] = end + 2, done[i] + n
        if crc16(frames) != sums:
            raise ValueError("a frame's checksum is wrong")
        active = [i for i in active if done[i] < state[i][1]]
    out = []
    for s, p, b in zip(state, parts, blocks, strict=True):
        samples = np.concatenate(p) if p else np.zeros(0, np.int64)
        signed = samples.astype("<i1" if s[0] <= 8 else "<i2")
        if s[2] != bytes(16) and hashlib.md5(signed.tobytes()).digest() != s[2]:
            raise ValueError("the decoded samples' MD5 is wrong")
        out.append((((signed.view(np.uint8) ^ 128) if s[0] <= 8 else signed).tobytes(), b))
    return out


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def runs(items: list[bytes], most: int = 1 << 21) -> list[tuple[int, int]]:
    """Bounds of runs of about `most` bytes."""
    cuts, size = [0], 0
    for i, x in enumerate(items):
        size += len(x)
        if size >= most:
            cuts.append(i + 1)
            size = 0
    if cuts[-1] < len(items):
        cuts.append(len(items))
    return list(zip(cuts, cuts[1:], strict=False))


def flac_encode(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media): whole texts as UTF-8, filled up with zeros to a positive multiple of 64, as a FLAC column.

    Null and empty texts become 64 zeros.
    """

    def make():
        def step(batch: dict) -> dict:
            media = []
            for a, b in runs(batch["text"]):
                media += encode([payload(x) for x in batch["text"][a:b]])
            return {"doc_id": batch["doc_id"], "n_bytes": [len(x) for x in batch["text"]], "media": media}

        return step

    return arrow_map(texts(docs, as_bytes=True), make, "doc_id long, n_bytes long, media binary")


def features(pcm: bytes) -> str:
    """Level, crossings and range of 8-bit samples, as text."""
    x = np.frombuffer(pcm, np.uint8).astype(np.float64) - 128
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"n={len(x)};rms={np.sqrt((x * x).mean()):.6f};zero_crossings={crossings};min={int(x.min())};max={int(x.max())}"


def flac_decode(media: DataFrame) -> DataFrame:
    """Adds to rows with a media column: pcm, its blocks (first sample, samples, byte offset of the frame) and features."""

    def make():
        def step(batch: dict) -> dict:
            got = []
            for a, b in runs(batch["media"]):
                got += decode(batch["media"][a:b])
            blocks = [[{"first_sample": f, "n_samples": n, "frame_offset": o} for f, n, o in b] for _, b in got]
            return batch | {"pcm": [x for x, _ in got], "blocks": blocks, "feature": [features(x) for x, _ in got]}

        return step

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return arrow_map(media, make, f"{kept}, pcm binary, blocks array<struct<first_sample:long,n_samples:long,frame_offset:long>>, feature string")


def write_pcm(decoded: DataFrame, path: str) -> DataFrame:
    """Writes decoded rows as a Parquet table of PCM: each with its blocks (first_sample, n_samples, frame_offset, pcm), and reads it back.

    The blocks of a row follow each other, so a sample is found by its block's first; the row's media, pcm and feature aren't written.
    """
    cut = F.transform("blocks", lambda b: F.struct(b["first_sample"].alias("first_sample"), b["n_samples"].alias("n_samples"), b["frame_offset"].alias("frame_offset"), F.substring(F.col("pcm"), (b["first_sample"] + 1).cast("int"), b["n_samples"].cast("int")).alias("pcm")))
    kept = [c for c in decoded.columns if c not in ("media", "pcm", "feature", "blocks")]
    decoded.select(*kept, cut.alias("blocks")).write.option("compression", "zstd").parquet(path)
    return decoded.sparkSession.read.parquet(path)


def pcm_blocks(table: DataFrame) -> DataFrame:
    """A row for each block of a PCM table: doc_id, first_sample, n_samples, frame_offset and the block's own samples."""
    return table.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")


def samples_at(table: DataFrame, first: int, n: int) -> DataFrame:
    """Rows (doc_id, pcm): n samples from a place on, of the blocks that hold them; fewer, or none, where a row ends before."""
    near = F.filter("blocks", lambda b: (b["first_sample"] < first + n) & (b["first_sample"] + b["n_samples"] > first))
    part = lambda b: F.substring(b["pcm"], F.greatest(F.lit(first) - b["first_sample"], F.lit(0)).cast("int") + 1, (F.least(F.lit(first + n), b["first_sample"] + b["n_samples"]) - F.greatest(F.lit(first), b["first_sample"])).cast("int"))
    return table.select("doc_id", F.aggregate(near, F.lit(b""), lambda held, b: F.concat(held, part(b))).alias("pcm"))


def pcm_digest(table: DataFrame) -> DataFrame:
    """Replaces the blocks of a PCM table by what their samples come to: payload_bytes, payload_sha256, tail_crc32 (of the last UNIT), feature, n_blocks."""

    def make():
        def step(batch: dict) -> dict:
            pcm = [b"".join(b["pcm"] for b in blocks) for blocks in batch.pop("blocks")]
            found = [(len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-UNIT:]), features(x)) for x in pcm]
            return batch | dict(zip(("payload_bytes", "payload_sha256", "tail_crc32", "feature"), map(list, zip(*found, strict=True)), strict=True))

        return step

    rows = table.withColumn("n_blocks", F.size("blocks"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "blocks")
    return arrow_map(rows, make, f"{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = flac_encode(table(spark, sf_dir, "documents"))
    media = media.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    pcm = write_pcm(flac_decode(media), shared_path(spark, "pcm"))
    return pcm_digest(pcm).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks")
