"""Repetition inside single texts, by bands of zstandard compression ratios.

How well prose compresses depends on the prose, so a limit on the ratio of its bytes can
prove nothing. Compressed here is the text's *word stream* instead: one code of four bytes
per word, as good as random. What is new in it does not compress at all, and a run of five
words that occurred before costs at most ``MATCH`` of its 20 bytes, wherever it occurred. A
text of ``n`` words with a share ``s`` of repeated runs therefore has a ratio of at most
``1 - s * (1 - MATCH / 20) + HEADER / (4 * n)``: the limit for its length. Texts above it are
rejected unseen; those under it are in the band ``repetitive`` and are measured exactly, as
the share of runs of consecutive words that are not new. The compressor looks at every
position (no skipping in incompressible stretches) and its window holds the whole stream.

Fixed chunks of ``CHUNK`` words are held against the same limit, which puts a long text with
one repetitive stretch into the band too. Texts whose bytes hardly compress (keys, encoded
data) are in the band ``incompressible``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.words import Hashes

MATCH, HEADER = 5.2, 40  # bytes: a match with its offset, at most; headers and tables of the format
CHUNK = 1_024  # words
#: (bytes below which it holds, ratio of the bytes at or above which a text is incompressible)
INCOMPRESSIBLE = ((400, 1.05), (1_500, 0.9), (None, 0.8))
WINDOW = 27  # log2 of the longest stream that can be compressed in one window; longer texts are measured exactly
WORDS = re.compile(r"[^\W_]+")


def limit(words: int, share: float = 0.3) -> float:
    """The ratio that a text of so many words with so many repeats cannot exceed."""
    return 1 - share * (1 - MATCH / 20) + HEADER / (4 * max(words, 1))


def incompressible(size: int, ratio: float) -> bool:
    return ratio >= next(r for most, r in INCOMPRESSIBLE if most is None or size < most)


def _compressor():
    """A function from a word stream to its ratio, 1.0 for none."""
    import zstandard

    by_size: dict[int, zstandard.ZstdCompressor] = {}

    def ratio(data: bytes) -> float:
        if not data:
            return 1.0
        log = min(WINDOW, max(10, len(data).bit_length()))
        if log not in by_size:
            by_size[log] = zstandard.ZstdCompressor(
                compression_params=zstandard.ZstdCompressionParameters(
                    window_log=log, chain_log=log + 1, hash_log=min(log, 26), search_log=8, min_match=6, target_length=256, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False
                )
            )
        return len(by_size[log].compress(data)) / len(data)

    return ratio


def stream(words: list[str], of: Hashes) -> np.ndarray:
    """The word codes of a text."""
    return np.fromiter(map(of.__getitem__, words), np.uint64, len(words)).astype(np.uint32)


def repeated_share(words: list[str], run: int = 5) -> tuple[int, float]:
    """``(runs, share)``: how many runs of ``run`` consecutive words there are, and 1 - distinct / runs (0 without runs)."""
    n = len(words) - run + 1
    if n <= 0:
        return 0, 0.0
    return n, 1 - len(set(zip(*(words[k:] for k in range(run))))) / n


def bands(texts: DataFrame, run: int = 5, exact: str | None = "repetitive", share: float = 0.3) -> DataFrame:
    """``(id, bytes, ratio, word_ratio, chunk_ratio, band, runs, share)`` of ``texts(id, text)``.

    ``ratio`` is that of the bytes, ``word_ratio`` that of the word stream, ``chunk_ratio`` the
    least of its chunks that are at least half full (``word_ratio`` where there is none). No
    text outside the band ``repetitive`` has ``share`` repeats or more. ``runs`` and ``share``
    are exact and null outside the band ``exact`` (None: measured for every text). Null and
    empty texts are in the band ``empty`` with 0 runs. Repeated rows of an id count once, as
    the longest text (ties: the greatest share); rows with a null id are left out.
    """
    schema = "id long, bytes long, ratio double, word_ratio double, chunk_ratio double, band string, runs long, share double"
    if run < 5:
        raise ValueError("the limits hold for runs of five words or more")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        plain, ratio, of = zstandard.ZstdCompressor(level=1), _compressor(), Hashes()
        for pdf in frames:
            out = []
            for i, t in zip(pdf["id"], pdf["text"]):
                if not t:
                    out.append((i, 0, 1.0, 1.0, 1.0, "empty", 0, 0.0))
                    continue
                data = t.encode("utf-8", "surrogatepass")
                words = WORDS.findall(t.lower())
                codes = stream(words, of)
                whole = ratio(codes.tobytes())
                parts = [codes[k : k + CHUNK] for k in range(0, len(codes), CHUNK)] if len(codes) > CHUNK else []
                part = min((ratio(p.tobytes()) for p in parts if len(p) * 2 >= CHUNK), default=whole)
                size = len(plain.compress(data)) / len(data)
                far = len(codes) * 4 >> WINDOW > 0  # repeats may lie outside the window
                if far or whole <= limit(len(codes), share) or (parts and part <= limit(CHUNK, share)):
                    band = "repetitive"
                else:
                    band = "incompressible" if incompressible(len(data), size) else "plain"
                runs, found = repeated_share(words, run) if exact is None or band == exact else (None, None)
                out.append((i, len(data), size, whole, part, band, runs, found))
            yield pd.DataFrame(out, columns=["id", "bytes", "ratio", "word_ratio", "chunk_ratio", "band", "runs", "share"]).astype({"runs": "Int64"})

    made = texts.filter(F.col("id").isNotNull()).select("id", "text").mapInPandas(work, schema)
    rest = [c for c in made.columns if c != "id"]
    return made.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("bytes", F.coalesce("share", F.lit(0.0)))).alias("r")).select("id", *[F.col("r")[c].alias(c) for c in rest])


def repetitive(texts: DataFrame, least_runs: int = 40, share: float = 0.3, run: int = 5) -> DataFrame:
    """``(id, runs, share)`` of the texts of the band ``repetitive`` with enough runs and repeated share, measured exactly."""
    return bands(texts, run, "repetitive", share).filter((F.col("runs") >= least_runs) & (F.col("share") >= share - 1e-12)).select("id", "runs", "share")
