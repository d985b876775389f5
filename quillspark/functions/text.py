"""Text analysis as Column expressions: tokens, contractions, stop words, stems, hashes, token estimates.

Every expression is SQL text first, so the same rule runs in any SQL engine; ``F.expr`` keeps it in codegen.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values -------------------------------------------------------------------------------------------------------

#: English function words.
_FUNCTION_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by
can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't
have haven't having he her here hers herself him himself his how i if in into is isn't it its itself let's me more most mustn't
my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she should shouldn't so some
such than that the their theirs them themselves then there these they this those through to too under until up very was wasn't
we were weren't what when where which while who whom why with won't would wouldn't you your yours yourself yourselves
""".split()

#: Function words that tell two documents apart, and so stay in the index.
_MEANINGFUL = """
no not nor cannot can't don't doesn't didn't won't wouldn't shouldn't couldn't isn't aren't wasn't weren't hasn't haven't hadn't
against few more most only same off out up down
""".split()

#: Negative contractions, which all mean ``not``.
NEGATIVE_CONTRACTIONS = """
don't doesn't didn't won't wouldn't shouldn't couldn't can't cannot isn't aren't wasn't weren't hasn't haven't hadn't ain't mustn't
needn't
""".split()

#: Suffixes with the least length of a word that loses them, first match wins.
SUFFIXES = [
    ("ational", 7), ("iveness", 8), ("fulness", 8), ("ousness", 8), ("ization", 8), ("ations", 7), ("ingly", 7), ("edly", 6), ("ement", 7), ("ness", 6), ("tion", 6),
    ("ment", 6), ("ies", 5), ("ing", 5), ("ers", 5), ("est", 5), ("ed", 4), ("es", 4), ("ly", 5), ("er", 5), ("s", 4),
]

# --------------------------------------------------------------------------------------------------------------------

STOP_WORDS = sorted(set(_FUNCTION_WORDS) - set(_MEANINGFUL))

WORD_PATTERN = r"[\p{L}\p{N}_']+"


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def spark_quoted(words: list[str]) -> str:
    """Word list for Spark SQL, in which a backslash escapes the quote."""
    return ", ".join('"' + w + '"' for w in words)


def fold_sql(x: str) -> str:
    """Case folding: lower case, with sharp s as ss."""
    return f"replace(lower({x}), 'ß', 'ss')"


def stem_sql(x: str) -> str:
    """Light stem of a folded token, as one CASE over the ordered suffixes."""
    cases = [f"WHEN length({x}) <= 3 THEN {x}"]
    for suffix, least in SUFFIXES:
        cut = f"substr({x}, 1, length({x}) - {len(suffix)})"
        if suffix == "ies":
            out = f"concat({cut}, 'y')"
        elif suffix == "es":
            sibilant = " OR ".join(f"{cut} LIKE '%{e}'" for e in ("s", "x", "z", "ch", "sh"))
            out = f"CASE WHEN {sibilant} THEN {cut} ELSE concat({cut}, 'e') END"
        elif suffix == "tion":
            out = f"concat({cut}, 't')"
        elif suffix in ("ing", "ed"):
            k = len(suffix)
            last, before = f"substr({x}, length({x}) - {k}, 1)", f"substr({x}, length({x}) - {k + 1}, 1)"
            out = f"CASE WHEN length({x}) > {k + 2} AND {last} = {before} AND {last} NOT IN ('l', 's', 'z') THEN substr({x}, 1, length({x}) - {k + 1}) ELSE {cut} END"
        else:
            out = cut
        cases.append(f"WHEN length({x}) >= {least} AND {x} LIKE '%{suffix}' THEN {out}")
    return f"CASE {' '.join(cases)} ELSE {x} END"


def tokens(text: Column) -> Column:
    """Folded words without possessives and stray apostrophes, in order; null gives none."""
    folded = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    raw = F.regexp_extract_all(folded, F.lit(WORD_PATTERN), F.lit(0))
    bare = F.transform(raw, lambda w: F.btrim(F.regexp_replace(w, r"'s$|'$|^'", ""), F.lit("'")))
    plain = F.when(F.instr(folded, "'") > 0, F.filter(bare, lambda w: w != "")).otherwise(raw)
    return plain


def kept_tokens(text: Column, keep_stop_words: bool = False) -> Column:
    """Tokens with negative contractions as ``not`` and without stop words, unstemmed."""
    folded = F.transform(tokens(text), lambda w: F.when(w.isin(NEGATIVE_CONTRACTIONS), F.lit("not")).otherwise(w))
    return folded if keep_stop_words else F.filter(folded, lambda w: ~w.isin(STOP_WORDS))


def stem(word: Column) -> Column:
    """Light stem of a folded token."""
    w, n = word, F.length(word)
    out = F.when(n <= 3, w)
    for suffix, least in SUFFIXES:
        k = len(suffix)
        cut = F.substring(w, F.lit(1), n - k)
        if suffix == "ies":
            made = F.concat(cut, F.lit("y"))
        elif suffix == "es":
            made = F.when(cut.rlike("(s|x|z|ch|sh)$"), cut).otherwise(F.concat(cut, F.lit("e")))
        elif suffix == "tion":
            made = F.concat(cut, F.lit("t"))
        elif suffix in ("ing", "ed"):
            last = F.substring(w, n - k, F.lit(1))
            twice = (n > k + 2) & (last == F.substring(w, n - k - 1, F.lit(1))) & ~last.isin("l", "s", "z")
            made = F.when(twice, F.substring(w, F.lit(1), n - k - 1)).otherwise(cut)
        else:
            made = cut
        out = out.when((n >= least) & w.endswith(suffix), made)
    return out.otherwise(w)


def analyze(text: Column, keep_stop_words: bool = False) -> Column:
    """Stemmed terms of a text, repeats included."""
    return F.transform(kept_tokens(text, keep_stop_words), stem)


def analyze_query(text: Column) -> Column:
    """Terms of a query; a query of stop words only keeps them."""
    terms = analyze(text)
    return F.when(F.size(terms) > 0, terms).otherwise(analyze(text, True))


def content_hash(text: Column) -> Column:
    """SHA-256 of the folded text with white space collapsed."""
    return F.sha2(F.replace(F.lower(F.regexp_replace(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), r"\s+", " ")), F.lit("ß"), F.lit("ss")), 256)


def normalize(text: Column) -> Column:
    """Line feeds for other line ends, no control characters but tab and line feed, trimmed."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\x00-\x08\x0b-\x1f]", "")
    return F.btrim(plain, F.lit(" \t\n"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; none for empty or null."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


#: Characters of text whose words are counted at once.
COUNT_CHARS = 1 << 20


def _kept_words(vocabulary: list[str]) -> pd.Series:
    """For each raw word what it counts as, by the rules of ``kept_tokens``; null where it doesn't count."""
    words = pd.Series(vocabulary, dtype=object)
    quoted = words.str.contains("'", regex=False)
    words[quoted] = words[quoted].str.replace(r"'s$|'$|^'", "", regex=True).str.strip("'")
    words = words.mask(words.isin(NEGATIVE_CONTRACTIONS), "not")
    return words.mask((words == "") | words.isin(STOP_WORDS))


def counted_words(texts: pa.Array):
    """Yields (words, row, word, tf, lengths) for slices of folded texts that follow each other.

    ``words`` are the slice's distinct kept tokens (``kept_tokens``); one entry of row, word (both numbers within the
    slice) and tf for each word of each row, in order of rows; ``lengths`` are all rows' numbers of kept tokens.
    """
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + COUNT_CHARS, "right")))
        part, at = texts.slice(at, end - at), end
        lists = pc.split_pattern_regex(pc.fill_null(part, ""), r"[^\p{L}\p{N}_']+")
        coded = pc.list_flatten(lists).dictionary_encode()
        row = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        code, words = pd.factorize(_kept_words(coded.dictionary.to_pylist()))
        code = code[np.asarray(coded.indices)] if len(code) else np.zeros(0, np.int64)
        row, code = row[code >= 0], code[code >= 0]
        wide = max(1, len(words))
        key, tf = np.unique(row * wide + code, return_counts=True)
        yield list(words), key // wide, key % wide, tf, np.bincount(row, minlength=len(part))


def folded_text(text: Column) -> Column:
    """Text in lower case, with sharp s as ss; null is empty."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def word_counts(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., words, tfs, length): the distinct kept tokens (``kept_tokens``) of each row's text, how often each stands there, all.

    Words are split and counted in Arrow batches, and their rules applied to each distinct word of a batch once; one row
    in, one row out, nothing is shuffled.
    """
    read = rows.select(*keys, folded_text(F.col(text)).alias("__t"))
    schema = StructType([*read.schema.fields[:-1], *StructType.fromDDL("words array<string>, tfs array<int>, length int").fields])

    def count(batches):
        for batch in batches:
            at = 0
            for words, row, word, tf, lengths in counted_words(batch.column(len(keys))):
                ends = pa.array(np.searchsorted(row, np.arange(len(lengths) + 1)).astype(np.int32))
                named = pa.array(words, pa.string()).take(pa.array(word))
                made = [pa.ListArray.from_arrays(ends, named), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32))), pa.array(lengths.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(lengths)) for c in batch.columns[: len(keys)]), *made], names=schema.names)
                at += len(lengths)

    return read.mapInArrow(count, schema)
