"""Media columns: texts stored losslessly as WAV, read back, and fingerprinted.

The samples pass a short-time Fourier transform; every local peak of the spectrogram is
paired with the next peaks, of its own frame too, and the pairs are kept as time-coded
integers: frame * 2**20 + f1 * 2**14 + f2 * 2**8 + dt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Samples a frame, hop, partners a peak, samples a transform call, and how far below its frame's strongest bin a peak may lie (1/16 of a doubling).
WINDOW, HOP, FAN, CHUNK, BELOW = 64, 32, 3, 1 << 20, 96

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_peaks long, fingerprints array<long>"


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono WAV whose samples are the payload's bytes."""
    import io
    import wave

    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(1)
        out.setframerate(rate)
        out.writeframes(payload)
    return buffer.getvalue()


def from_wav(media: bytes) -> bytes:
    import io
    import wave

    with wave.open(io.BytesIO(media), "rb") as got:
        return got.readframes(got.getnframes())


def peaks(samples: bytes):
    """(frame, bin) of the spectrogram's local peaks, by frame and bin: bins above those
    beside them in frequency and not below those of the next frames, at most BELOW under
    their frame's strongest bin, which is always one. Levels are rounded to 1/16 of a
    doubling; of equal ones the lower bin is the peak."""
    import numpy as np

    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    hann = np.hanning(WINDOW + 1)[:-1].astype(np.float32)
    n = (len(x) - WINDOW) // HOP + 1
    found = []
    for start in range(0, n, CHUNK // HOP):
        stop = min(n, start + CHUNK // HOP)
        first, last = max(start - 1, 0), min(stop + 1, n)  # a frame more on either side
        frames = np.lib.stride_tricks.sliding_window_view(x[first * HOP : (last - 1) * HOP + WINDOW], WINDOW)[::HOP]
        power = np.abs(np.fft.rfft(frames * hann, axis=1))[:, 1:]
        level = np.full((last - first + 2, power.shape[1] + 2), -1, np.int32)
        level[1:-1, 1:-1] = np.rint(16 * np.log2(power + 1))
        own = level[1:-1, 1:-1]
        best = own.argmax(axis=1)
        peak = (own > level[1:-1, :-2]) & (own >= level[1:-1, 2:]) & (own >= level[:-2, 1:-1]) & (own >= level[2:, 1:-1])
        peak &= own >= own[np.arange(len(own)), best][:, None] - BELOW
        peak[np.arange(len(own)), best] = True
        frame, bins = np.nonzero(peak[start - first : stop - first])
        found.append(np.stack([frame + start, bins + 1]))
    return n, np.concatenate(found, axis=1).astype(np.int64)


def pair_codes(points):
    """Time-coded pairs of each peak with the next FAN ones, sorted by time."""
    import numpy as np

    frame, level = points
    codes = [frame[:-d] << 20 | level[:-d] << 14 | level[d:] << 8 | np.minimum(frame[d:] - frame[:-d], 255) for d in range(1, FAN + 1) if len(frame) > d]
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def media_features(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): the stored form's sizes and digests, and
    features of what was read back. A null text is empty; an empty text is stored as 64
    zero bytes; equal texts give equal values, repeated rows are each returned, long
    texts are transformed in chunks of frames (a WAV file holds below 4 GiB).
    """

    small_batches(docs.sparkSession)

    def run(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()), ("n_peaks", pa.int64()), ("fingerprints", pa.list_(pa.int64()))])
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                media = to_wav(text + bytes(-len(text) % 64 if text else 64))
                payload = from_wav(media)
                n, points = peaks(payload)
                codes = pair_codes(points)
                feature = f"stft{WINDOW}:{n}:{points.shape[1]}:{len(codes)}:{zlib.crc32(codes.astype('<i8').tobytes()):08x}"
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, n, points.shape[1], codes))
            columns = list(zip(*rows)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text")).mapInArrow(run, SCHEMA)
