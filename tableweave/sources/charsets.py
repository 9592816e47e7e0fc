"""Which charset explains the bytes of a file that is not UTF-8.

Every line that is no valid UTF-8 is decoded in each candidate charset. Lines that do not
decode rule a candidate out; the characters of the others are weighed by how likely text
in that charset is to hold them, by class and by the row of the charset's table they stand
in, since common characters stand in its first rows. Sums per file and candidate are
combined in tasks, then over the file; the best mean weight wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates; ties go to the first.
CANDIDATES = ("cp932", "shift_jis", "euc_jp", "gb18030", "big5", "euc_kr", "latin1", "windows-1252")
#: Forms of two-byte characters, told by a mark or by where zero bytes stand.
WIDE = ("utf-16le", "utf-16be")
#: Names that options may give for charsets that Spark's reader need not know.
CODECS = {*CANDIDATES, *WIDE, "euc-jp", "gbk", "gb2312", "big5hkscs", "euc-kr", "cp1252", "koi8-r", "windows-1251", "iso-8859-2", "windows-1250"}

# First bytes of the rows of common ideographs in each charset.
_COMMON_ROWS = {
    "cp932": range(0x88, 0x98), "shift_jis": range(0x88, 0x98), "euc_jp": range(0xB0, 0xD0),
    "gb18030": range(0xB0, 0xD8), "big5": range(0xA4, 0xC7), "euc_kr": range(0xB0, 0xC9),
}
#: Japanese text is told by its syllables, Korean text is nearly all in common rows.
_COMMON_WEIGHT = {"euc_kr": 1.5, "gb18030": 1.4, "big5": 1.4}
_QUOTES_AND_DASHES = set("‘’“”„‚–—…€™•«»")


def weight(char: str, charset: str) -> float:
    """How well a character outside ASCII fits text in a charset."""
    code = ord(char)
    many_bytes = charset in _COMMON_ROWS
    if many_bytes and 0x3000 <= code <= 0x30FF:  # punctuation and syllables
        return 3.0 if charset in ("cp932", "shift_jis", "euc_jp") else 2.0 if code < 0x3040 else 0.0
    if many_bytes and 0xFF00 <= code <= 0xFF60:  # full-width forms
        return 1.5
    if many_bytes and (0x4E00 <= code <= 0x9FFF or 0xAC00 <= code <= 0xD7A3):
        common = char.encode(charset, "replace")[0] in _COMMON_ROWS[charset]
        return _COMMON_WEIGHT.get(charset, 1.2) if common else 0.25
    if not many_bytes and (0xC0 <= code <= 0xFF and code not in (0xD7, 0xF7) or char in _QUOTES_AND_DASHES):
        return 1.0
    if not many_bytes and 0xA0 <= code <= 0x17F:
        return 0.5
    return -2.0 if code < 0xA0 or 0xE000 <= code <= 0xF8FF or 0xFF61 <= code <= 0xFF9F else -0.5


def _weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, line) to (path, charset, failed, weight, chars), a row per file and candidate of a task."""
    sums: dict[tuple[str, str], list[float]] = {}
    known: dict[tuple[str, str], float] = {}
    for batch in batches:
        for path, lines in batch.groupby("path")["line"]:
            for charset in CANDIDATES:
                seen, failed = Counter(), 0
                for line in lines:
                    try:
                        seen.update(bytes(line).decode(charset))
                    except UnicodeDecodeError:
                        failed += 1
                total = sums.setdefault((path, charset), [0, 0.0, 0])
                total[0] += failed
                for char, count in seen.items():
                    if char > "\x7f":
                        if (char, charset) not in known:
                            known[char, charset] = weight(char, charset)
                        total[1] += count * known[char, charset]
                        total[2] += count
    yield pd.DataFrame(
        [(*key, *total) for key, total in sums.items()], columns=["path", "charset", "failed", "weight", "chars"]
    )


def judged(lines: DataFrame) -> DataFrame:
    """(path, judged.encoding) of the files that ``lines`` (path, line) come from; null if none fits."""
    sums = (
        lines.mapInPandas(_weighed, "path string, charset string, failed long, weight double, chars long")
        .groupBy("path", "charset")
        .agg(F.sum("failed").alias("failed"), (F.sum("weight") / F.greatest(F.sum("chars"), F.lit(1))).alias("mean"))
    )
    place = F.array_position(F.array(*[F.lit(c) for c in CANDIDATES]), F.col("charset"))
    fits = (F.col("failed") == 0) & (F.col("mean") > 0)
    best = F.max(F.when(fits, F.struct("mean", (-place).alias("place"), "charset")))
    return sums.groupBy("path").agg(F.struct(best.getField("charset").alias("encoding")).alias("judged"))


def wide_form(head: bytes) -> str | None:
    """The form of two-byte characters that the first bytes of a file show."""
    if head[:2] == b"\xff\xfe":
        return WIDE[0]
    if head[:2] == b"\xfe\xff":
        return WIDE[1]
    even, odd = head[::2].count(0), head[1::2].count(0)  # no other text holds zero bytes
    return None if even == odd else WIDE[0] if odd > even else WIDE[1]
