"""Telephony audio: mu-law, A-law and IMA ADPCM in WAV, expanded to resampled 16-bit PCM.

The companded codecs are expanded by lookup tables of 256 entries.  ADPCM blocks are independent, so their samples are
decoded one place at a time with numpy across all blocks.  PCM is resampled by a polyphase windowed sinc.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_batches, mapped, quoted, without

RATE, BLOCK = 8000, 64
CODECS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
_TAGS = {v: k for k, v in CODECS.items()}
#: Samples of a block: one in its header, two in each byte after the header of four.
PER_BLOCK = 1 + 2 * (BLOCK - 4)
# Fixed values of the IMA ADPCM format: step sizes, and changes of the step index by code without its sign.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


@lru_cache
def table(codec: str) -> np.ndarray:
    """The 16-bit sample of each of the 256 codes."""
    code = np.arange(256, dtype=np.int32) ^ (0xFF if codec == "mulaw" else 0x55)
    mantissa, exponent = code & 15, code >> 4 & 7
    if codec == "mulaw":
        size = ((mantissa << 3) + 0x84 << exponent) - 0x84
        return np.where(code & 0x80, -size, size).astype(np.int16)
    size = np.where(exponent > 0, (mantissa << 4) + 0x108 << np.maximum(exponent - 1, 0), (mantissa << 4) + 8)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks: bytes, a block to a row.  Samples, a block to a row; a step index beyond the table is its last."""
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(head[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(codes):
        step = STEPS[index]
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code & 7], 0, len(STEPS) - 1)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def write_wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAV file that holds the payload as it is; ADPCM takes whole blocks only."""
    if codec == "adpcm":
        if len(payload) % BLOCK:
            raise ValueError("ADPCM takes whole blocks")
        samples = len(payload) // BLOCK * PER_BLOCK
        form = struct.pack("<HHIIHHHH", CODECS[codec], 1, rate, rate * BLOCK // PER_BLOCK, BLOCK, 4, 2, PER_BLOCK)
    else:
        samples, form = len(payload), struct.pack("<HHIIHHH", CODECS[codec], 1, rate, rate, 1, 8, 0)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload) & 0xFFFFFFFF) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", (len(chunks) + 4) & 0xFFFFFFFF) + b"WAVE" + chunks


class Wav(NamedTuple):
    codec: str
    rate: int
    payload: memoryview
    block: int  # bytes of an ADPCM block, or of a sample


def read_wav(data: bytes) -> Wav:
    """A mono telephony WAV file; ValueError for anything else."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > len(data):
            raise ValueError("cut short")
        if name == b"fmt ":
            if size < 16:
                raise ValueError("no format")
            tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            form = (_TAGS.get(tag), rate, block)
            if form[0] is None or channels != 1 or rate == 0 or (bits, block) != (8, 1) and form[0] != "adpcm" or form[0] == "adpcm" and (bits != 4 or block < 5):
                raise ValueError("a format that isn't telephony")
        elif name == b"data":
            if form is None or size % form[2]:
                raise ValueError("no format, or not whole blocks")
            return Wav(form[0], form[1], memoryview(data)[at + 8 : at + 8 + size], form[2])
        at += 8 + size + (size & 1)
    raise ValueError("no data")


@lru_cache
def _phases(up: int, down: int, half: int = 4) -> tuple[np.ndarray, ...]:
    """Filters of the phases of the output, each 2 * half input samples long, of unit sum."""
    out, cut = [], min(1.0, up / down)
    for p in range(up):
        t = np.arange(-half + 1, half + 1) - (p * down % up) / up
        h = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / half, -1, 1)))
        out.append((h / h.sum()).astype(np.float32))
    return tuple(out)


def resampled(pcm: np.ndarray, up: int, down: int, half: int = 4) -> np.ndarray:
    """16-bit PCM at up / down times its rate: ceil(n * up / down) samples; outside it there is silence."""
    n, filters = len(pcm), _phases(up, down, half)
    total = -(-n * up // down)
    x = np.zeros(n + 2 * half, np.float32)
    x[half - 1 : half - 1 + n] = pcm
    out = np.empty(total, np.int16)
    for p in range(min(up, total)):
        y = np.correlate(x, filters[p], "valid")  # y[i] is centred between the input's samples i and i + 1
        places = (np.arange(p, total, up, dtype=np.int64) * down) // up
        out[p::up] = np.clip(np.rint(y if down == 1 and len(y) == len(places) else y[places]), -32768, 32767)
    return out


PIECE = 1 << 18
#: Bytes of media that are decoded together, and leave a Python worker together.
HELD = 1 << 20


def pcm_pieces(wav: Wav) -> Iterator[np.ndarray]:
    """Samples of a clip, a bounded number at a time."""
    raw = np.frombuffer(wav.payload, np.uint8)
    step = PIECE if wav.codec != "adpcm" else max(1, PIECE // wav.block) * wav.block
    for i in range(0, len(raw), step):
        yield table(wav.codec)[raw[i : i + step]] if wav.codec != "adpcm" else adpcm(raw[i : i + step].reshape(-1, wav.block)).ravel()


def adpcm_together(files: list[Wav | None]) -> dict[int, np.ndarray]:
    """Samples of the batch's ADPCM files of up to PIECE bytes, by place: blocks of one size are decoded together, PIECE * 8 bytes at a time."""
    out: dict[int, np.ndarray] = {}
    held: dict[int, list[tuple[int, np.ndarray]]] = {}

    def decode(block: int) -> None:
        some = held.pop(block)
        pcm = adpcm(np.concatenate([x for _, x in some]))
        ends = np.cumsum([len(x) for _, x in some])
        out.update((i, part.ravel()) for (i, _), part in zip(some, np.split(pcm, ends[:-1])))

    for i, wav in enumerate(files):
        if wav and wav.codec == "adpcm" and 0 < len(wav.payload) <= PIECE:
            same = held.setdefault(wav.block, [])
            same.append((i, np.frombuffer(wav.payload, np.uint8).reshape(-1, wav.block)))
            if sum(len(x) for _, x in same) * wav.block > PIECE * 8:
                decode(wav.block)
    for block in list(held):
        decode(block)
    return out


def resampled_pieces(pieces: Iterator[np.ndarray], up: int, down: int) -> Iterator[np.ndarray]:
    """PCM at up / down times its rate, as resampled() gives it for the whole; two pieces are held at a time."""
    halo, done, held = 64 * down, 0, np.zeros(0, np.int16)  # held: samples before the piece, for its left context
    pcm = next(pieces, None)
    while pcm is not None:
        after = next(pieces, None)
        whole = np.concatenate([held, pcm, after[:halo]] if after is not None else [held, pcm])
        begin = done - len(held)  # of `whole`, among all samples; a multiple of down
        first, end = -(-done * up // down), -(-(done + len(pcm)) * up // down)
        yield resampled(whole, up, down)[first - begin * up // down : end - begin * up // down]
        done += len(pcm)
        held = np.concatenate([held, pcm])[-(halo + done % down) :]
        pcm = after


def telephony_stored(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all, if not said), n_bytes (long) and media (binary): each text's UTF-8 bytes, padded with
    bytes 0 to a positive multiple of 64, as the payload of a WAV file.  Its codec is given by the payload's crc32, so
    equal texts give equal files.  A null text counts as empty; columns named n_bytes or media are replaced; repeated rows
    repeat; an empty table gives an empty one.  A file is one value, so a text may have about 2 GB."""
    arrow_batches(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("n_bytes", "media")]
    source = df.select(*[quoted(c) for c in keep], *([] if text_col in keep else [quoted(text_col)]))
    at, n = source.columns.index(text_col), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(CODECS)
        for batch in batches:
            sizes, files = [], []
            for value in batch.column(at):
                data = (value.as_py() or "").encode()
                payload = data + b"\0" * (-len(data) % BLOCK if data else BLOCK)
                sizes.append(len(data))
                files.append(write_wav(payload, names[zlib.crc32(payload) % 3]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], [*batch.schema.names[:n], "n_bytes", "media"])

    return mapped(source, run, T.StructType([*source.schema.fields[:n], *T._parse_datatype_string("n_bytes long, media binary").fields]))


def _read(data: bytes | None) -> Wav | None:
    try:
        return read_wav(data or b"")
    except ValueError:
        return None


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch by HELD bytes of the column at a place at most, or one by one: its PCM is several times as large."""
    begin, held = 0, 0
    for i, value in enumerate(batch.column(at)):
        size = value.as_buffer().size if value.is_valid else 0
        if i > begin and held + size > HELD:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _decoded(files: list[Wav | None], up: int, down: int) -> Iterator[tuple]:
    """Codec, rate, samples and PCM of each file."""
    together = adpcm_together(files)
    for i, wav in enumerate(files):
        if wav is None:
            yield (None,) * 4
            continue
        n = len(wav.payload) if wav.codec != "adpcm" else len(wav.payload) // wav.block * (1 + 2 * (wav.block - 4))
        pieces = iter([together.pop(i)]) if i in together else pcm_pieces(wav)
        yield wav.codec, wav.rate * up // down, n, b"".join([y.astype("<i2").tobytes() for y in resampled_pieces(pieces, up, down)])


def _columns(rows: list[tuple], fields: list[T.StructField]) -> list[pa.Array]:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return [pa.array(x, kinds[f.dataType.simpleString()]) for x, f in zip(zip(*rows) if rows else [[]] * len(fields), fields)]


def telephony_decoded(df: DataFrame, media_col: str = "media", up: int = 2, down: int = 1) -> DataFrame:
    """df and: codec (string), rate (int, of the PCM), n_samples (long, at the clip's own rate) and pcm (binary: little-endian 16 bits).

    Null media, or media that isn't a mono telephony WAV of whole blocks, gives nulls; a clip without samples gives an
    empty pcm.  Columns of df with the names of results are replaced; repeated rows repeat; an empty table gives an empty
    one.  A long clip is decoded and resampled piece by piece into its one value.
    """
    arrow_batches(df.sparkSession)
    fields = T._parse_datatype_string("codec string, rate int, n_samples long, pcm binary").fields
    df = without(df, *[f.name for f in fields if f.name != media_col.lower()])
    at = df.columns.index(media_col)
    if media_col.lower() in [f.name for f in fields]:
        raise ValueError(f"the media column can't be named {media_col}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                files = [_read(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *_columns(list(_decoded(files, up, down)), fields)], [*part.schema.names, *[f.name for f in fields]])

    return mapped(df, run, T.StructType([*df.schema.fields, *fields]))


def feature(codec: str, rate: int, pcm: bytes) -> str:
    """Codec, rate, samples, root mean square, peak, zero crossings (sign changes, zero being positive) and crc32 of PCM."""
    samples, squares, peak, crossings, last = np.frombuffer(pcm, "<i2"), 0, 0, 0, None
    for i in range(0, len(samples), PIECE):
        wide = samples[i : i + PIECE].astype(np.int64)
        squares += int((wide * wide).sum())
        peak = max(peak, int(np.abs(wide).max()))
        sign = wide >= 0
        crossings += int((sign[1:] != sign[:-1]).sum()) + (last is not None and last != bool(sign[0]))
        last = bool(sign[-1])
    return f"{codec};{rate};{len(samples)};{(squares / max(1, len(samples))) ** 0.5:.3f};{peak};{crossings};{zlib.crc32(pcm):08x}"


def _media_digest(data: bytes | None, wav: Wav | None) -> tuple:
    row = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
    return row + ((None,) * 3 if wav is None else (len(wav.payload), hashlib.sha256(wav.payload).hexdigest(), zlib.crc32(wav.payload[-64:])))


_DIGEST = "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def telephony_read(df: DataFrame, media_col: str = "media", up: int = 2, down: int = 1) -> DataFrame:
    """df with the columns of telephony_decoded() and, instead of the media, those of telephony_digest(): in one pass, so
    that the PCM isn't sent to Python again.  Rows, nulls and names of columns are as there."""
    arrow_batches(df.sparkSession)
    fields = T._parse_datatype_string("codec string, rate int, n_samples long, pcm binary, " + _DIGEST).fields
    df = without(df, *[f.name for f in fields if f.name != media_col.lower()])
    at = df.columns.index(media_col)
    if media_col.lower() in [f.name for f in fields]:
        raise ValueError(f"the media column can't be named {media_col}")
    kept = [i for i in range(len(df.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                media = part.column(at).to_pylist()
                files, rows = [_read(x) for x in media], []
                for data, wav, sound in zip(media, files, _decoded(files, up, down)):
                    codec, rate, _, pcm = sound
                    rows.append((*sound, *_media_digest(data, wav), None if pcm is None else feature(codec, rate, pcm)))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *_columns(rows, fields)], [*[part.schema.names[i] for i in kept], *[f.name for f in fields]])

    return mapped(df, run, T.StructType([df.schema.fields[i] for i in kept] + fields))


def telephony_digest(df: DataFrame, media_col: str = "media", pcm_col: str = "pcm", with_pcm: bool = False) -> DataFrame:
    """Instead of the media, and of the PCM unless with_pcm: media_bytes, media_sha256, payload_bytes, payload_sha256,
    tail_crc32 (of its last 64 bytes) and feature, of the PCM.  Media that can't be read has nulls but for the first two."""
    arrow_batches(df.sparkSession)
    fields = T._parse_datatype_string(_DIGEST).fields
    df = without(df, *[f.name for f in fields if f.name not in (media_col.lower(), pcm_col.lower())])
    media, pcm, codec, rate = (df.columns.index(c) for c in (media_col, pcm_col, "codec", "rate"))
    kept = [i for i in range(len(df.columns)) if i != media and (with_pcm or i != pcm)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, sound, name, hertz in zip(batch.column(media), batch.column(pcm), batch.column(codec).to_pylist(), batch.column(rate).to_pylist()):
                data, sound = data.as_py(), sound.as_py()
                rows.append((*_media_digest(data, _read(data)), None if sound is None else feature(name, hertz, sound)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *_columns(rows, fields)], [*[batch.schema.names[i] for i in kept], *[f.name for f in fields]])

    return mapped(df, run, T.StructType([df.schema.fields[i] for i in kept] + fields))
