"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.session import ship_package

#: Characters under the rolling hash.
WINDOW = 32
_FACTOR = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[ \t ]*(?:\r\n|\n|\r)\s*")
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'»“”’)\]]*\s+|[。！？]+")
_BLANK = re.compile(r"\s+")


def rolling_hashes(text: str) -> np.ndarray:
    """For every cut position from 1 to the length, the hash of the (at most) WINDOW characters before it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    mixed = (codes + np.uint64(1)) * _MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    # The sum of mixed[i - back] * FACTOR^back over the window is a difference of prefix sums, for the factor has an inverse modulo 2^64.
    prefix = np.cumsum(mixed * np.cumprod(np.full(len(codes), _INVERSE)))
    prefix[WINDOW:] -= prefix[:-WINDOW].copy()
    out = prefix * np.cumprod(np.full(len(codes), _FACTOR))
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(27))


#: What may stand at the end of a paragraph, line or sentence before its last blank.
_AT_END = set(".!?…。！？\"'»“”’)]")


def _nearest(text: str, last: int, low: int, high: int, target: int) -> int | None:
    """The end of a paragraph, else line, else sentence, else word within [low, high] that is nearest to ``target``.

    Only the reach is searched: a match that ends there begins after the last cut, behind no more than blanks and closing signs.
    """
    first = low
    while first > last and (text[first - 1].isspace() or text[first - 1] in _AT_END):
        first -= 1
    runs_on = high < len(text) and text[high].isspace()
    inside = text[high - 1 : high + 1] == "\r\n"
    for pattern in (_PARAGRAPH, _LINE, _SENTENCE, _BLANK):
        ends = [m.end() for m in pattern.finditer(text, first, high)]
        ends = [e for e in ends if e >= low and not (e == high and (inside if pattern is _LINE else runs_on))]
        if ends:
            return min(ends, key=lambda e: (abs(e - target), e))
    return None


def _joined(text: str, at: int) -> bool:
    """Whether a cut at this place would part what belongs to one character."""
    return bool(unicodedata.combining(text[at])) or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d" or text[at - 1 : at + 1] == "\r\n"


def cut_points(text: str, core: int, least: int) -> list[int]:
    """Where to cut: the last point is the text's end, no two points are more than ``core`` apart.

    Within [least, core] characters after the last cut, the landmark is the position with the smallest rolling hash. The cut snaps
    to the paragraph end nearest to it, else line end, else sentence end, else blank, else stands at the landmark, but never inside
    CR LF or before a combining mark. Hash and boundaries depend on nearby text only, so after an edit the cuts soon fall on the
    same places as before.
    """
    n, least = len(text), max(1, min(least, core))
    if n <= core:
        return [n]
    cuts, at = [], 0
    while n - at > core:
        low, high = at + least, at + core
        if n - least >= low:
            high = min(high, n - least)  # leaves no short tail
        # Only the reach of this cut is hashed: memory does not follow the length of the text.
        first = max(0, low - WINDOW)
        landmark = low + int(np.argmin(rolling_hashes(text[first:high])[low - 1 - first :]))
        cut = _nearest(text, at, low, high, landmark)
        if cut is None:
            cut = landmark
            while cut > low and _joined(text, cut):
                cut -= 1
        cuts.append(cut)
        at = cut
    return [*cuts, n]


def split_text(text: str, max_chars: int, min_chars: int = 0, overlap_chars: int = 0) -> list[tuple[int, int, int]]:
    """Pieces as (start, end, overlap): the piece is text[start:end], its first ``overlap`` characters repeat the piece before.

    No piece has more than ``max_chars`` characters. An overlap has ``overlap_chars`` characters, or the fewer that let it begin
    with a whole word if one begins in its first half, and else with a whole character. It may reach over more than one piece, but
    an overlap that leaves no room for anything new is an error. Without the overlaps the pieces are the text again.
    """
    max_chars, overlap = max(1, max_chars), max(0, overlap_chars)
    if overlap >= max_chars:
        raise ValueError(f"an overlap of {overlap} characters leaves no room in pieces of {max_chars}")
    if len(text) <= max_chars:
        return [(0, len(text), 0)]
    pieces, start = [], 0
    for end in cut_points(text, max_chars - overlap, min_chars):
        first = _overlap_start(text, max(0, start - overlap), start) if start else 0
        pieces.append((first, end, start - first))
        start = end
    return pieces


def _overlap_start(text: str, low: int, cut: int) -> int:
    """Where an overlap that may begin at ``low`` begins."""
    if low == 0 or low == cut:
        return low
    if not text[low - 1].isspace() or _joined(text, low):
        for m in _BLANK.finditer(text, low, (low + cut + 1) // 2):
            if m.end() < cut and not _joined(text, m.end()):
                return m.end()
    while low < cut and _joined(text, low):
        low += 1
    return low


PIECES = "array<struct<piece_no:int,start_char:int,overlap:int,content:string>>"


def split_oversized(df: DataFrame, config: DataFrame, row_id: Sequence[str], content: str = "content", heading: str | None = "heading", profile: str = "profile") -> DataFrame:
    """Every row as pieces within the limits of its profile: ids, heading, ``piece_no``, ``start_char``, ``overlap``, ``content``, ``was_split``.

    One scan, no shuffle: only oversized texts go through Arrow to Python, each text on its own; rows within their limit pass inside
    the JVM as one piece, and no other column leaves it. ``config`` (profile, max_chars, min_chars, overlap_chars) is one row per
    profile; it joins by Spark's own choice of strategy, by size. Defined cases: lengths are Unicode code points; null content is one
    piece with null content; empty content is one empty piece; a row whose profile is null or not configured stays whole; a profile
    configured twice counts with its smallest limits; headings are kept on every piece as they are; a profile whose overlap is not
    below its limit is an error before anything is read.
    """
    ship_package(df.sparkSession)
    limits = config.groupBy(F.col(profile).alias("__qs_profile")).agg(F.min("max_chars").alias("__qs_max"), F.min("min_chars").alias("__qs_min"), F.min("overlap_chars").alias("__qs_over"))
    if wrong := limits.where("__qs_max IS NOT NULL AND __qs_over >= greatest(__qs_max, 1)").select("__qs_profile").first():
        raise ValueError(f"profile {wrong[0]}: the overlap leaves no room for anything new")
    names = [*row_id, *(["heading"] if heading else [])]
    kept = [F.col(f"`{c}`").alias(c) for c in row_id] + ([F.col(f"`{heading}`").alias("heading")] if heading else [])
    rows = df.select(*kept, F.col(f"`{content}`").alias("__qs_text"), F.col(f"`{profile}`").alias("__qs_p")).join(limits, F.col("__qs_p") == F.col("__qs_profile"), "left")

    @F.arrow_udf(PIECES)
    def cut(texts: pa.Array, most: pa.Array, least: pa.Array, over: pa.Array) -> pa.Array:
        ends, number, start, lead, content = [0], [], [], [], []
        for t, a, b, c in zip(texts.to_pylist(), most.to_pylist(), least.to_pylist(), over.to_pylist()):
            for i, (x, y, shared) in enumerate(split_text(t, a, b, c)) if t is not None else ():
                number.append(i)
                start.append(x)
                lead.append(shared)
                content.append(t[x:y])
            ends.append(len(number))
        flat = pa.StructArray.from_arrays([pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(lead, pa.int32()), pa.array(content, pa.string())], ["piece_no", "start_char", "overlap", "content"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pyarrow.compute.is_null(texts))

    large = F.coalesce(F.length("__qs_text") > F.when(F.col("__qs_max") < 1, 1).otherwise(F.col("__qs_max")), F.lit(False))
    number = lambda c: F.coalesce(F.when(large, F.col(c)), F.lit(0))
    found = rows.withColumn("__qs_pieces", cut(F.when(large, F.col("__qs_text")), number("__qs_max"), number("__qs_min"), number("__qs_over")))
    whole = F.array(F.struct(F.lit(0).alias("piece_no"), F.lit(0).alias("start_char"), F.lit(0).alias("overlap"), F.col("__qs_text").alias("content")))
    out = found.select(*[F.col(f"`{n}`") for n in names], F.explode(F.coalesce("__qs_pieces", whole.cast(PIECES))).alias("__qs_piece"), large.alias("was_split"))
    return out.select(*[F.col(f"`{n}`") for n in names], *[F.col(f"__qs_piece.{c}").alias(c) for c in ("piece_no", "start_char", "overlap", "content")], "was_split")
