"""Fill-in-the-middle: a text is cut into prefix, middle and suffix and rearranged around marks.

A unit is a run of A-Z, a-z or any other single code point. One ``fullmatch`` of
``(unit)*`` by the regex library keeps every repetition of its group, so
``match.ends(1)`` is at once the number of units n and the offset after each of
them: both cuts are two look-ups in that list.

Four unsigned numbers h1 to h4 come from the sha256 of ``seed:doc_id``. The prefix
ends after the smaller of h1 % (n+1) and h2 % (n+1) units, the middle after the
larger. A text is left plain if h3 % 100 >= ``rate``, if it is empty, or if it holds
a mark (it could not be restored); else h4 % 100 < ``spm_rate`` picks the order:

    psm  <P>prefix<S>suffix<M>middle        spm  <S>suffix<P>prefix<M>middle

``restored`` inverts this with SQL functions. No part holds a mark and no mark
overlaps itself or another one, so the first place of each mark is the one set here.

Defined cases: a null text is an empty one (plain, n = 0, output empty). A null
doc_id is hashed as the empty string. Repeated rows repeat; an empty table gives no
rows; extra columns are ignored. A task holds one Arrow batch, the outputs of
``SLICE_CHARS`` characters, and the captures of one text (about 200 bytes a unit).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import doc_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Possessive: the unit after a run can't start with a letter, so no other split of a text exists.
UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
#: Characters of text whose outputs are returned together.
SLICE_CHARS = 8_000_000


def draws(doc_id: int | None, seed: int) -> list[int]:
    """h1 to h4."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]


def rearranged(doc_id: int | None, text: str, seed: int = 1, rate: int = 90,
               spm_rate: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """n, form, characters of the prefix and of the middle (None if plain), output."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (ends[k - 1] if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row."""
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def batch_of(ids: list, rows: list) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())] + [
            pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", *names])

    def mapped(batches):
        for batch in batches:
            ids, rows, size = [], [], 0
            for i in range(batch.num_rows):  # one text at a time leaves Arrow's memory
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""
                ids.append(doc_id)
                rows.append(rearranged(doc_id, text, seed, rate, spm_rate))
                size += len(text)
                if size > SLICE_CHARS:
                    yield batch_of(ids, rows)
                    ids, rows, size = [], [], 0
            if rows:
                yield batch_of(ids, rows)

    return doc_rows(docs).mapInArrow(
        mapped, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))

    def between(mark, end):  # from behind a mark up to a place
        return F.substring(output, mark + 3, end - mark - 3)

    middle = F.substring(output, m + 3, F.length(output))
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(transformed: DataFrame) -> DataFrame:
    """The contract's columns: digests of the output and of the text restored from it."""
    text = restored(F.col("output"), F.col("form"))
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                              F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                              F.sha2(text.cast("binary"), 256).alias("restored_sha256"))


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
             CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
             array_to_string(units[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""
