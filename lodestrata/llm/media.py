"""Telephony audio columns: companded 8-bit samples, ADPCM blocks and resampled PCM.

A document's UTF-8 bytes serve as 8-bit telephone samples. They are stored, without
loss, in a RIFF/WAVE file whose format is mu-law at 8 kHz; the file is parsed again and
the samples are expanded by lookup tables (mu-law and A-law) and, seen as IMA ADPCM
blocks, decoded with numpy one step at a time across all blocks. The mu-law signal is
also resampled to 16 kHz PCM, which is a column of its own. In it every other sample
lies between its neighbours; so it is stored by what differs from that, without loss.

Defined results: a null or empty text counts as no bytes, so its payload is 192 spaces;
the same text always gives the same file and features; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays
from .shared import picked, written

BLOCK = 192
PAD = 32
RATE = 8000
MU_LAW = 7
A_LAW = 6

#: Fixed values of the IMA ADPCM format: how an index moves, by code without its sign.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Fixed values of the IMA ADPCM format: the quantiser's steps.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
     130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
     1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
     8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


def mu_law_table() -> np.ndarray:
    """16-bit sample of each mu-law code (G.711)."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit sample of each A-law code (G.711)."""
    code = np.arange(256) ^ 0x55
    level, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(level == 0, low + 8, (low + 264) << np.maximum(level - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MU_TABLE, A_TABLE = mu_law_table(), a_law_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks, one row each: a first sample and two for each byte after the header.

    blocks: uint8 of shape (n, size). Every step decodes one nibble of all blocks. A
    header's index is held to the table, so that any bytes decode.
    """
    rows, size = blocks.shape
    columns = np.ascontiguousarray(blocks.T)
    out = np.empty((1 + 2 * (size - 4), rows), np.int16)
    value = (columns[0].astype(np.uint16) | columns[1].astype(np.uint16) << 8).view(np.int16).astype(np.int32)
    index = np.minimum(columns[2], 88).astype(np.int32)
    out[0] = value
    at = 1
    for k in range(4, size):
        for code in (columns[k] & 15, columns[k] >> 4):
            step = STEPS[index]
            magnitude = (code & 7).astype(np.int32)
            move = step >> 3
            move += np.where(magnitude & 4, step, 0)
            move += np.where(magnitude & 2, step >> 1, 0)
            move += np.where(magnitude & 1, step >> 2, 0)
            value += np.where(code & 8, -move, move)
            np.clip(value, -32768, 32767, out=value)
            index += INDEX_MOVES[magnitude]
            np.clip(index, 0, 88, out=index)
            out[at] = value
            at += 1
    return out.T


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; the last sample is held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    wide = pcm.astype(np.int32)
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    out[-1:] = pcm[-1:]
    return out


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """What ``n`` samples after each of ``even`` are likely to be: the mean of both neighbours, after the last one itself."""
    out = even[:n].copy()
    wide = even.astype(np.int32)
    out[: len(even) - 1] = (wide[:-1] + wide[1:]) >> 1
    return out


def code_pcm(pcm: bytes) -> bytes:
    """Any 16-bit little-endian PCM, without loss: every other sample, then how far the rest are from the means of their neighbours."""
    samples = np.frombuffer(pcm, "<i2")
    even, odd = samples[::2], samples[1::2]
    return even.tobytes() + (odd - _between(even, len(odd))).tobytes()  # modulo 2**16


def decode_pcm(coded: bytes) -> bytes:
    samples = np.frombuffer(coded, "<i2")
    n = len(samples) // 2
    even, rest = samples[: len(samples) - n], samples[len(samples) - n :]
    out = np.empty(len(samples), "<i2")
    out[::2] = even
    out[1::2] = _between(even, n) + rest
    return out.tobytes()


def pad(raw: bytes) -> bytes:
    short = -len(raw) % BLOCK if raw else BLOCK
    return raw + bytes([PAD]) * short


def write_wave(samples: bytes, kind: int = MU_LAW) -> bytes:
    """A RIFF/WAVE file of one channel of 8-bit samples."""
    odd = len(samples) & 1
    form = struct.pack("<HHIIHHH", kind, 1, RATE, RATE, 1, 8, 0)
    fact = struct.pack("<I", len(samples))
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v for k, v in ((b"fmt ", form), (b"fact", fact), (b"data", samples))) + b"\0" * odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(file: bytes) -> tuple[int, bytes]:
    """Format code and samples; walks the chunks."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, kind = 12, -1
    while at + 8 <= len(file):
        name, (size,) = file[at : at + 4], struct.unpack_from("<I", file, at + 4)
        if name == b"fmt ":
            (kind,) = struct.unpack_from("<H", file, at + 8)
        elif name == b"data":
            return kind, file[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def features(payloads: list[bytes], pcm: list[bytes | None]) -> list[str]:
    """One line for each payload: level and zero crossings of both expansions, ADPCM level, and a checksum of its 16 kHz PCM (made here where none was kept)."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    n = np.array([len(p) for p in payloads])
    first = np.cumsum(n) - n
    parts = []
    for table in (MU_TABLE, A_TABLE):
        wave = table[raw].astype(np.int64)
        level = np.add.reduceat(wave * wave, first) // n
        turn = np.zeros(len(wave), np.int64)
        turn[1:] = (wave[1:] < 0) != (wave[:-1] < 0)
        turn[first] = 0
        parts += [level, np.add.reduceat(turn, first)]
    blocks = raw.reshape(-1, BLOCK)
    power = np.empty(len(blocks), np.int64)
    for a in range(0, len(blocks), 16384):
        decoded = decode_adpcm(blocks[a : a + 16384]).astype(np.int64)
        power[a : a + 16384] = (decoded * decoded).sum(1)
    parts.append(np.add.reduceat(power, first // BLOCK) // (n // BLOCK * (1 + 2 * (BLOCK - 4))))
    out = []
    for k, (a, size) in enumerate(zip(first.tolist(), n.tolist())):
        wide = resample_double(MU_TABLE[raw[a : a + size]]).tobytes() if pcm[k] is None else pcm[k]
        mu, mu_turns, al, al_turns, adpcm = (int(x[k]) for x in parts)
        out.append(f"mu={mu}/{mu_turns};a={al}/{al_turns};adpcm={adpcm};pcm16k={zlib.crc32(wide):08x}")
    return out


#: Coded PCM repeats what repeats in a text at twice the length: a higher level finds it.
ZSTD_LEVEL = 9

STORED = "doc_id long, n_bytes long, media binary, pcm binary"


def store(docs: DataFrame, keep_pcm: bool = True, coded: bool = False) -> DataFrame:
    """doc_id, n_bytes, media (the WAVE file) and pcm (16-bit little-endian at 16 kHz, or as ``code_pcm`` codes it; null unless kept)."""
    put = code_pcm if coded else bytes

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches):
            raw = [b or b"" for b in piece.column("text").cast(pa.large_binary()).to_pylist()]
            files = [write_wave(pad(b)) for b in raw]
            pcm = [put(resample_double(MU_TABLE[np.frombuffer(pad(b), np.uint8)]).tobytes()) for b in raw] if keep_pcm else [None] * len(raw)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(files, pa.binary()), pa.array(pcm, pa.binary())], names=["doc_id", "n_bytes", "media", "pcm"])

    return picked(docs, "doc_id", "text").transform(arrays.mapped, encode, STORED)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(stored: DataFrame, coded: bool = False) -> DataFrame:
    """Reads the stored files back: digests of file and payload, and the features; ``coded``: whether PCM was stored so."""
    got = decode_pcm if coded else bytes

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrays.pieces(batches, "media"):
            files = piece.column("media").to_pylist()
            samples = [read_wave(f)[1] for f in files]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("n_bytes"),
                    pa.array([len(s) for s in samples], pa.int64()),
                    pa.array([hashlib.sha256(s).hexdigest() for s in samples], pa.string()),
                    pa.array([zlib.crc32(s[-16:]) for s in samples], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in files], pa.string()),
                    pa.array(features(samples, [p if p is None else got(p) for p in piece.column("pcm").to_pylist()]), pa.string()),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return stored.select("doc_id", "n_bytes", "media", "pcm").transform(arrays.mapped, decode, DIGESTS)


def telephony_digests(docs: DataFrame) -> DataFrame:
    """The columns of the query: each document stored as audio and as 16 kHz PCM in the shared folder, both read back."""
    return digests(written(store(docs, coded=True), "media", "zstd", ZSTD_LEVEL), coded=True)
