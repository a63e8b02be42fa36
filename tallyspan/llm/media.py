"""Media columns: ISO media containers.

A container is a tree of boxes. The reader walks the nested boxes, decodes the sample tables
(sizes, chunks, offsets, times, sync samples) and keeps codec, duration and the byte ranges
of keyframes as columns; payload bytes are never decoded, only addressed. The writer makes
containers of 8-bit samples, so that any bytes can be kept as a media column and read back.

Work is a narrow map over rows: nothing is shuffled, and memory is one batch.

Every track is described: its sample table, then the runs of samples in movie fragments. The
flat columns are those of the first video track that has samples, else of the first with samples.

Defined results: null bytes or text count as empty; a payload is padded to whole frames; a
container that is cut off, has no track, or whose tables point outside it gives a row with
``problem`` set and nothing else, never a failed job, however deep its boxes nest; a very long
text is one value, and its container with it, as large as the text; equal texts give equal
values; repeated rows are answered each; an empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspan.llm.common import ship, texts

ship(__name__)

FRAME, PAD = 576, 255
TIMESCALE, SAMPLES_PER_CHUNK, KEY_EVERY = 48_000, 16, 8
#: Fixed names of the container format: boxes that hold boxes, and the sample entry of unsigned 8-bit audio.
NESTING = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
CODEC = b"raw "


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def write_container(payload: bytes, frame: int = FRAME) -> bytes:
    """A container with one audio track whose samples are the payload's frames of 8-bit units."""
    n = len(payload) // frame
    if n * frame != len(payload) or not n:
        raise ValueError("the payload is not a positive number of frames")
    chunks = -(-n // SAMPLES_PER_CHUNK)
    rest = n - (chunks - 1) * SAMPLES_PER_CHUNK
    keys = range(1, n + 1, KEY_EVERY)
    duration = n * frame
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(CODEC, b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    runs = [(1, SAMPLES_PER_CHUNK)] if chunks > 1 or rest == SAMPLES_PER_CHUNK else []
    if rest != SAMPLES_PER_CHUNK:
        runs.append((chunks, rest))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def movie(first: int) -> bytes:
        offsets = [first + k * SAMPLES_PER_CHUNK * frame for k in range(chunks)]
        wide = first + len(payload) >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, frame)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", k, m, 1) for k, m in runs]),
            full(b"stsz", struct.pack(">II", frame, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", b"\0" * 4), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration & 0xFFFFFFFF, 0x55C4, 0))
        hdlr = full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"sound\0")
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, duration & 0xFFFFFFFF), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, b"\0" * 8, flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, duration & 0xFFFFFFFF, 0x10000, 0x100), b"\0" * 10, matrix, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    data = box(b"mdat", payload)
    start = len(head) + len(movie(0)) + len(data) - len(payload)
    return head + movie(start) + data


def walk(data: memoryview):
    """(kind, number, number of the box around it, start, start of body, end) of every box, outer ones first.

    Boxes wait on a list of their own, so nesting may be as deep as the file allows.
    """
    waiting, number = [(0, len(data), -1)], 0
    while waiting:
        start, end, around = waiting.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError("a box ends outside its parent")
        yield kind, number, around, start, body, start + size
        waiting.append((start + size, end, around))
        if kind in NESTING:
            waiting.append((body, start + size, number))
        number += 1


def entries(data: memoryview, at: tuple[int, int], form: str, skip: int = 4) -> list:
    """Rows of a box that holds version and flags, a count, and so many entries."""
    a, b = at
    (n,) = struct.unpack_from(">I", data, a + skip)
    one = struct.Struct(">" + form)
    if a + skip + 4 + n * one.size > b:
        raise ValueError("a table is cut off")
    return list(one.iter_unpack(data[a + skip + 4 : a + skip + 4 + n * one.size]))


def sample_table(data: memoryview, t: dict) -> tuple[list, list, int]:
    """(byte ranges, numbers of the sync samples, duration) of a track's own sample table."""
    duration = sum(n * d for n, d in entries(data, t[b"stts"], "II"))
    even, n = struct.unpack_from(">II", data, t[b"stsz"][0] + 4)
    if even and n * even > len(data):
        raise ValueError("more samples than bytes")
    sizes = [even] * n if even else [x for (x,) in entries(data, t[b"stsz"], "I", 8)]
    chunks = [x for (x,) in (entries(data, t[b"co64"], "Q") if b"co64" in t else entries(data, t[b"stco"], "I"))]
    layout = entries(data, t[b"stsc"], "III")
    firsts = [first for first, _, _ in layout]
    if n and (firsts[:1] != [1] or any(a >= b for a, b in zip(firsts, firsts[1:]))):
        raise ValueError("chunk runs are not in order from 1")
    ranges, k = [], 0
    for i, (first, per, _) in enumerate(layout):
        upto = layout[i + 1][0] - 1 if i + 1 < len(layout) else len(chunks)
        for offset in chunks[first - 1 : upto]:
            for _ in range(min(per, n - k)):
                if offset + sizes[k] > len(data):
                    raise ValueError("a sample lies outside the file")
                ranges.append((offset, sizes[k]))
                offset, k = offset + sizes[k], k + 1
    if k != n:
        raise ValueError("chunks don't hold every sample")
    keys = [x - 1 for (x,) in entries(data, t[b"stss"], "I")] if b"stss" in t else list(range(n))
    if any(not 0 <= x < n for x in keys):
        raise ValueError("a sync sample is none of the samples")
    return ranges, keys, duration


def fragment(data: memoryview, moof: int, head: tuple[int, int], runs_: list, defaults: tuple[int, int, int], start: int | None, room: int):
    """(byte ranges, sync samples, duration, end) of one track fragment; start is where the one before it ended.

    defaults are the movie's duration, size and flags of a sample; room is how many samples may still come.
    """
    a = head[0]
    flags = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF
    at = a + 8
    base = moof if flags & 0x20000 or start is None else start
    duration, size, kind = defaults
    for bit, form in ((0x1, "Q"), (0x2, "I"), (0x8, "I"), (0x10, "I"), (0x20, "I")):
        if flags & bit:
            (x,) = struct.unpack_from(">" + form, data, at)
            at += struct.calcsize(form)
            base, duration, size, kind = (x if bit == 0x1 else base), (x if bit == 0x8 else duration), (x if bit == 0x10 else size), (x if bit == 0x20 else kind)
    if flags & 0x20000 and not flags & 0x1:
        base = moof
    ranges, keys, total, offset = [], [], 0, base
    for a, b in runs_:
        flags, n = struct.unpack_from(">II", data, a)
        flags &= 0xFFFFFF
        at = a + 8
        if flags & 0x1:
            offset = base + struct.unpack_from(">i", data, at)[0]
            at += 4
        first = None
        if flags & 0x4:
            (first,) = struct.unpack_from(">I", data, at)
            at += 4
        fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        if at + 4 * len(fields) * n > b or n > room - len(ranges):
            raise ValueError("a run of samples is cut off")
        for k in range(n):
            one = dict(zip(fields, struct.unpack_from(f">{len(fields)}I", data, at)))
            at += 4 * len(fields)
            length = one.get(0x200, size)
            if offset < 0 or offset + length > len(data):
                raise ValueError("a sample lies outside the file")
            how = first if k == 0 and first is not None else one.get(0x400, kind)
            if not how & 0x10000:  # set where a sample depends on others
                keys.append(len(ranges))
            ranges.append((offset, length))
            total += one.get(0x100, duration)
            offset += length
    return ranges, keys, total, offset


def read_container(raw: bytes) -> list[dict]:
    """Every track that has a sample description: handler, codec, timescale, duration, byte ranges of its samples
    and of its keyframes, from its sample table and then from movie fragments."""
    data = memoryview(raw)
    kinds, parents, tracks, of, defaults, fragments = {}, {}, [], {}, {}, []
    for kind, number, around, start, a, b in walk(data):
        kinds[number], parents[number] = kind, around
        if kind == b"trak":
            of[number] = {}
            tracks.append(of[number])
        elif kind == b"moof":
            of[number] = {"moof": start}
        elif kind == b"traf":
            of[number] = {"moof": of[around]["moof"] if kinds.get(around) == b"moof" else start, "runs": []}
            fragments.append(of[number])
        else:
            if around in of:
                of[number] = of[around]  # boxes inside a track belong to it
            t = of.get(number)
            if kind == b"trex":
                track, _, *rest = struct.unpack_from(">IIIII", data, a + 4)
                defaults[track] = tuple(rest)
            elif kind == b"trun" and t is not None and "runs" in t:
                t["runs"].append((a, b))
            elif t is not None:
                t.setdefault(kind, (a, b))
    out, by_id, end = [], {}, None
    for t in tracks:
        if b"stsd" not in t:
            continue
        a = t[b"stsd"][0]
        one = {"handler": "", "codec": bytes(data[a + 12 : a + 16]).decode("latin1")}
        if b"hdlr" in t:
            one["handler"] = bytes(data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]).decode("latin1")
        a = t[b"mdhd"][0]
        one["timescale"] = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
        ranges, keys, one["duration"] = sample_table(data, t) if b"stsz" in t else ([], [], 0)
        one["ranges"], one["keyframes"] = ranges, [ranges[i] for i in keys]
        if b"tkhd" in t:
            a = t[b"tkhd"][0]
            by_id[struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]] = one
        out.append(one)
    if not out:
        raise ValueError("no track with samples")
    moof, samples = None, sum(len(x["ranges"]) for x in out)
    for f in fragments:
        track = struct.unpack_from(">I", data, f[b"tfhd"][0] + 4)[0]
        if track not in by_id:
            raise ValueError("a fragment of no track")
        one = by_id[track]
        # a first fragment starts at its movie fragment, others where the last one ended
        start, moof = (end if f["moof"] == moof else None), f["moof"]
        ranges, keys, duration, end = fragment(data, f["moof"], f[b"tfhd"], f["runs"], defaults.get(track, (0, 0, 0)), start, len(data) - samples)
        samples += len(ranges)
        one["ranges"] += ranges
        one["keyframes"] += [ranges[i] for i in keys]
        one["duration"] += duration
    return out


def main_track(tracks: list[dict]) -> dict:
    """The first video track with samples, else the first with samples, else the first."""
    held = [t for t in tracks if t["ranges"]]
    return next((t for t in held if t["handler"] == "vide"), (held or tracks)[0])


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring byte ranges as one."""
    out: list[list[int]] = []
    for a, n in ranges:
        if out and out[-1][0] + out[-1][1] == a:
            out[-1][1] += n
        else:
            out.append([a, n])
    return [(a, n) for a, n in out]


def padded(payload: bytes, frame: int = FRAME) -> bytes:
    return payload + bytes([PAD]) * (max(1, -(-len(payload) // frame)) * frame - len(payload))


RANGE = pa.struct([("offset", pa.int64()), ("length", pa.int64())])
KEYFRAMES = pa.list_(RANGE)
TRACKS = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", KEYFRAMES)]))
_KEYS = "array<struct<offset:long,length:long>>"


def described(t: dict) -> dict:
    keys = [{"offset": a, "length": n} for a, n in t["keyframes"]]
    return {"handler": t["handler"], "codec": t["codec"], "duration_s": t["duration"] / max(1, t["timescale"]), "n_samples": len(t["ranges"]), "keyframes": keys}


def describe_containers(media: DataFrame, ident: str, content: str) -> DataFrame:
    """(ident, codec, duration_s, n_samples, keyframes, tracks, media_bytes, problem) of a binary column of
    containers: the main track's figures, and those of every track."""

    def run(batches):
        for batch in batches:
            rows = {k: [] for k in ("codec", "duration_s", "n_samples", "keyframes", "tracks", "media_bytes", "problem")}
            for raw in batch.column(1).to_pylist():
                raw = raw or b""
                try:
                    got = read_container(raw)
                    own = described(main_track(got))
                    one = (own["codec"], own["duration_s"], own["n_samples"], own["keyframes"], [described(t) for t in got], len(raw), None)
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    one = (None, None, None, None, None, len(raw), f"{type(e).__name__}: {e}")
                for k, v in zip(rows, one):
                    rows[k].append(v)
            kinds = (pa.string(), pa.float64(), pa.int64(), KEYFRAMES, TRACKS, pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(rows.values(), kinds)]], names=[ident, *rows])

    kind = media.schema[ident].dataType.simpleString()
    tracks = f"array<struct<handler:string,codec:string,duration_s:double,n_samples:long,keyframes:{_KEYS}>>"
    schema = f"`{ident}` {kind}, codec string, duration_s double, n_samples long, keyframes {_KEYS}, tracks {tracks}, media_bytes long, problem string"
    return media.select(ident, content).mapInArrow(run, schema)


def store_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded bytes as a container, a binary column."""

    def run(batches):
        for batch in batches:
            raw = texts(batch)
            # one row at a time leaves this task; containers are as large as their texts
            for a in range(0, len(raw), 256):
                part = raw[a : a + 256]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, len(part)), pa.array([len(x) for x in part], pa.int64()), pa.array([write_container(padded(x)) for x in part], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digest_media(stored: DataFrame) -> DataFrame:
    """Digest columns of (doc_id, n_bytes, media): the payload is gathered through the sample table."""

    def run(batches):
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        for batch in batches:
            rows = {k: [] for k in names}
            for raw in batch.column("media").to_pylist():
                got = main_track(read_container(raw))
                payload = b"".join([raw[a : a + n] for a, n in joined(got["ranges"])])
                keys = got["keyframes"]
                feature = f"codec={got['codec'].strip()};timescale={got['timescale']};duration={got['duration']};samples={len(got['ranges'])};keyframes={len(keys)};first={keys[0][0]}+{keys[0][1]};last={keys[-1][0]}+{keys[-1][1]}"
                one = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature)
                for k, v in zip(names, one):
                    rows[k].append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(v, k) for v, k in zip(rows.values(), kinds)]], names=["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(run, schema)


def media_digests(documents: DataFrame) -> DataFrame:
    """Every text stored as a container column, read back and described."""
    return digest_media(store_texts(documents))
