"""Flag the rows whose key matches a list: equal, suffix, substring or wildcard.

A list is a Python sequence or a DataFrame with an ``entry`` column.  A sequence
of up to LITERAL_LIMIT entries becomes one expression: no join, no shuffle.  Any
other list is matched by equality joins alone, so the cost per key depends on the
key's length and not on the length of the list or on how its entries' lengths vary:

* the distinct keys are cut into q-grams, one for each position,
* every entry is filed under the q-gram of its own that fewest keys hold,
* keys meet the entries filed under their q-grams, at most PART in a row, and are tested
  against each,
* the matching keys are joined back.

Equal keys and endings at a dot need no q-grams: they are looked up as they are.  No job runs
while a plan is built.  No join is hinted: Spark broadcasts a side only when its size is known to be
under ``spark.sql.autoBroadcastJoinThreshold`` and else sort-merges, where
adaptive execution splits a key that holds a large part of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmine.functions.text import any_of, literal
from contactmine.operators.settle import settle

LITERAL_LIMIT = 200

# Length of q-grams; shorter entries are filed under all of themselves.
GRAM = 3
# Entries in one row of the index.
PART = 100

# any case, also outside ASCII; "." stops at line feeds only
_WILDCARD_MODE = "(?idu)"

Entries = Sequence[str] | DataFrame


def bounded_list(entries: DataFrame, limit: int = LITERAL_LIMIT) -> Entries:
    """The entries as a Python list when there are at most ``limit``, else unchanged."""
    head = [row[0] for row in entries.select("entry").distinct().limit(limit + 1).collect()]
    return sorted(head) if len(head) <= limit else entries


def _is_literal(entries: Entries) -> bool:
    return not isinstance(entries, DataFrame) and len(entries) <= LITERAL_LIMIT


def _as_frame(df: DataFrame, entries: Entries) -> DataFrame:
    if isinstance(entries, DataFrame):
        return entries.select("entry").filter(F.col("entry").isNotNull()).distinct()
    rows = [(entry,) for entry in sorted(set(entries))]
    return df.sparkSession.createDataFrame(rows, "entry string")


def _with_test(df: DataFrame, flag: str, key: Column, pattern: str) -> DataFrame:
    """``flag`` from one pattern; an empty one matches nothing."""
    found = F.coalesce(key.rlike(pattern), F.lit(False)) if pattern else F.lit(False)
    return df.withColumn(flag, found)


def flag_equal(df: DataFrame, key: Column, entries: Entries, flag: str) -> DataFrame:
    """``flag`` is true where ``key`` is in the list."""
    if _is_literal(entries):
        return df.withColumn(flag, F.coalesce(key.isin(list(entries)), F.lit(False)))
    listed = _as_frame(df, entries).select(F.col("entry").alias("_entry"), F.lit(True).alias("_hit"))
    return _join_back(df, key, listed, flag)


def flag_equal_each(df: DataFrame, lists: Sequence[tuple[str, Column, Entries]]) -> DataFrame:
    """``flag_equal`` for several ``(flag, key, entries)`` of which a row has a key for one at most.

    The long lists are one table of lists and entries, so that a row is looked up once."""
    long = [(flag, key, entries) for flag, key, entries in lists if not _is_literal(entries)]
    for flag, key, entries in lists:
        if _is_literal(entries):
            df = flag_equal(df, key, entries, flag)
    if not long:
        return df
    named = lambda flag, key: F.concat(F.lit(f"{flag}:"), key)  # noqa: E731  null where the key is
    lookup = F.coalesce(*(named(flag, key) for flag, key, _ in long))
    tables = [_as_frame(df, entries).select(named(flag, F.col("entry")).alias("entry")) for flag, _, entries in long]
    flagged = flag_equal(df, lookup, reduce(DataFrame.unionByName, tables), "_listed")
    return flagged.withColumns({flag: F.col("_listed") & key.isNotNull() for flag, key, _ in long}).drop("_listed")


def flag_suffix(
    df: DataFrame, key: Column, entries: Entries, flag: str, dot_boundary: bool = False
) -> DataFrame:
    """``flag`` is true where ``key`` ends with an entry.

    With ``dot_boundary`` the entry has to be the whole key or to follow a dot.
    """
    if _is_literal(entries):
        start = r"(?:^|\.)" if dot_boundary else ""
        return _with_test(df, flag, key, entries and rf"{start}{any_of(entries)}\z")
    listed = _as_frame(df, entries)
    if dot_boundary:
        labels = F.split("_key", r"\.")
        endings = F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )
        return _flag_by_fragments(df, key, lambda keys: _explode(keys, endings), listed, flag)
    return _flag_by_grams(df, key, _whole(listed), flag, lambda text, entry: F.endswith(text, entry["entry"]))


def flag_substring(df: DataFrame, key: Column, entries: Entries, flag: str) -> DataFrame:
    """``flag`` is true where an entry stands anywhere in ``key``."""
    if _is_literal(entries):
        return _with_test(df, flag, key, any_of(entries))
    listed = _whole(_as_frame(df, entries))
    return _flag_by_grams(df, key, listed, flag, lambda text, entry: F.contains(text, entry["entry"]))


def flag_wildcard(df: DataFrame, key: Column, entries: Entries, flag: str) -> DataFrame:
    """``flag`` is true where an entry, ``*`` standing for any text, is found in ``key``.

    Case is ignored, of any script: key and entry are compared character by character in the form
    that ``folded`` gives, whatever the length of the list.
    """
    if _is_literal(entries):
        pieces = [[_folded_literal(p) for p in e.split("*")] for e in entries]
        pattern = F.concat(F.lit("(?d)"), *_between([_between(e, ".*") for e in pieces], "|"))
        found = F.coalesce(F.rlike(folded(key), pattern), F.lit(False)) if pieces else F.lit(False)
        return df.withColumn(flag, found)
    entry = folded(F.col("entry"))
    listed = _as_frame(df, entries).select(entry.alias("entry")).distinct()
    listed = listed.select("entry", F.split("entry", r"\*").alias("pieces"))
    return _flag_by_grams(df, key, listed, flag, _holds_in_turn, folded)


def _folded_literal(piece: str) -> list[Column]:
    return [F.lit(literal(piece.lower()))] if piece.isascii() else [F.lit("\\Q"), folded(F.lit(piece)), F.lit("\\E")]


def _between(parts: list[list[Column]], separator: str) -> list[Column]:
    out = list(parts[0]) if parts else []
    for part in parts[1:]:
        out += [F.lit(separator), *part]
    return out


def _holds_in_turn(text: Column, entry: Column) -> Column:
    """Whether the entry's pieces follow each other in ``text``, as its pattern asks for."""
    after = F.aggregate(
        entry["pieces"], F.lit(1),
        lambda at, piece: F.when(at == 0, at).otherwise(
            _place_after(F.call_function("locate", piece, text, at), piece, text, at)
        ),
    )
    # "." of a pattern stops at line feeds
    line_feed = F.contains(text, F.lit("\n"))
    return F.when(line_feed, F.rlike(text, wildcard_pattern(entry["entry"]))).otherwise(after > 0)


def _place_after(found: Column, piece: Column, text: Column, at: Column) -> Column:
    return F.when(piece == "", at).when(found == 0, found).otherwise(found + F.length(piece))


def wildcard_pattern(entry: Column) -> Column:
    """Java pattern of a wildcard entry: ``*`` → any text, all else literal, any case."""
    quoted = F.regexp_replace(entry, r"([ -)+-/:-@\[-^`{-~])", r"\\$1")
    return F.concat(F.lit(_WILDCARD_MODE), F.replace(quoted, F.lit("*"), F.lit(".*")))


def folded(value: Column) -> Column:
    """One form of all spellings that a pattern of any case takes for the same, character by character.

    A character stays one: those whose other case is several characters keep their own, or
    that of the other direction."""
    each = F.array_join(F.transform(F.split(value, ""), _folded_character), "")
    return F.when(F.octet_length(value) == F.length(value), F.lower(value)).otherwise(each)


def _folded_character(c: Column) -> Column:
    # one right on top of the other, Spark would take the inner one for superfluous
    both, low = F.lower(F.concat(F.upper(c), F.lit(""))), F.lower(c)
    return F.when(F.length(both) == 1, both).when(F.length(low) == 1, low).otherwise(F.substring(low, 1, 1))


def _whole(listed: DataFrame) -> DataFrame:
    return listed.select("entry", F.array("entry").alias("pieces"))


def _explode(keys: DataFrame, fragments: Column) -> DataFrame:
    return keys.select("_id", F.explode(F.array_distinct(fragments)).alias("_fragment"))


def _grams(text: Column, size: int) -> Column:
    """All fragments of ``size`` characters, by one linear pass."""
    every = rf"(?s)(?![\x{{dc00}}-\x{{dfff}}])(?=(.{{{size}}}))"
    return F.regexp_extract_all(text, F.lit(every), F.lit(1))


def _grams_of_all(pieces: Column, size: int) -> Column:
    return F.flatten(F.transform(pieces, lambda piece: _grams(piece, size)))


def _sized(listed: DataFrame) -> DataFrame:
    longest = F.array_max(F.transform("pieces", F.length))
    return listed.withColumn("_size", F.least(F.lit(GRAM), longest))


def _has_size(listed: DataFrame, size: int) -> Column:
    """Whether some entry's grams have that size: one of the few distinct sizes, looked up when the plan runs."""
    sizes = _sized(listed).select("_size").distinct().filter(F.col("_size") == size)
    return F.coalesce(sizes.select(F.lit(True).alias("found")).scalar(), F.lit(False))


def _index(listed: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grams of the keys ``[_id, _fragment]`` and the entries ``[_fragment, _part, _entries]`` filed under them.

    An entry's grams are as long as its longest piece allows, GRAM at most."""
    sized = _sized(listed)
    pieces = F.col("pieces")
    cut = F.when(F.col("_size") == GRAM, _grams_of_all(pieces, GRAM))
    found = _grams(F.col("_key"), GRAM)
    none = F.array().cast("array<string>")
    for size in range(1, GRAM):
        cut = cut.when(F.col("_size") == size, _grams_of_all(pieces, size))
        found = F.concat(found, F.when(_has_size(listed, size), _grams(F.col("_key"), size)).otherwise(none))
    filed = sized.filter(F.col("_size") > 0).select("entry", "pieces", F.explode(F.array_distinct(cut)).alias("_fragment"))
    grams = _explode(keys, found)
    counts = grams.join(filed.select("_fragment").distinct(), "_fragment", "left_semi").groupBy("_fragment").agg(F.count(F.lit(1)).alias("_n"))
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_fragment")).alias("_at")
    filed = filed.join(counts, "_fragment", "left").groupBy("entry", "pieces").agg(rarest)
    filed = filed.filter(F.col("_at._n") > 0).select("entry", "pieces", "_at._fragment")
    slots = filed.groupBy("_fragment").agg(F.ceil(F.count(F.lit(1)) / PART).alias("_slots"))
    parted = filed.join(slots, "_fragment").withColumn("_part", F.pmod(F.xxhash64("entry"), F.col("_slots")))
    return grams, parted.groupBy("_fragment", "_part").agg(F.collect_list(F.struct("entry", "pieces")).alias("_entries"))


def _named_keys(df: DataFrame, key: Column) -> DataFrame:
    """Distinct ``[_key, _id]``; fragments carry ``_id``, so that a very long key is not repeated."""
    whole = F.col("_key")
    digest = F.concat(F.lit("\x00"), F.sha2(whole, 256))
    keys = df.select(key.alias("_key")).filter(whole.isNotNull()).distinct()
    return keys.withColumn("_id", F.when(F.length(whole) <= 64, whole).otherwise(digest))


def _flag_by_grams(
    df: DataFrame,
    key: Column,
    listed: DataFrame,
    flag: str,
    test: Callable[[Column, Column], Column],
    fold: Callable[[Column], Column] = lambda key: key,
) -> DataFrame:
    """Flag keys that pass ``test`` with an entry of ``listed``, ``[entry, pieces]``, all of whose pieces they have to hold."""
    df = settle(df)  # read twice: for its keys and for the join back
    keys = _named_keys(df, fold(key))
    grams, index = _index(listed, keys)
    met = grams.join(index, "_fragment").select("_id", "_entries")
    passed = F.exists("_entries", lambda entry: test(F.col("_key"), entry))
    hits = keys.join(met, "_id").filter(passed).select("_key").distinct()
    # an entry without any character holds for every key
    every = _has_size(listed, 0)
    hits = hits.select(F.col("_key").alias("_entry"), F.lit(True).alias("_hit"))
    flagged = _join_back(df, fold(key), hits, flag)
    return flagged.withColumn(flag, F.col(flag) | (every & key.isNotNull()))


def _flag_by_fragments(
    df: DataFrame, key: Column, cut: Callable[[DataFrame], DataFrame], listed: DataFrame, flag: str
) -> DataFrame:
    """Flag keys with a fragment in the list."""
    df = settle(df)  # read twice: for its keys and for the join back
    keys = _named_keys(df, key)
    found = cut(keys).join(listed, F.col("_fragment") == F.col("entry"), "left_semi").select("_id").distinct()
    hits = keys.join(found, "_id", "left_semi")
    return _join_back(df, key, hits.select(F.col("_key").alias("_entry"), F.lit(True).alias("_hit")), flag)


def _join_back(df: DataFrame, key: Column, hits: DataFrame, flag: str) -> DataFrame:
    """Left-join the hits; rows without a key are spread out instead of sharing one partition."""
    spread = F.concat(F.lit("\x00"), (F.xxhash64(*df.columns) % 4096).cast("string"))
    keyed = df.withColumn("_has", key.isNotNull()).withColumn("_key", F.coalesce(key, spread))
    joined = keyed.join(hits, (F.col("_key") == F.col("_entry")) & F.col("_has"), "left")
    return joined.withColumn(flag, F.coalesce("_hit", F.lit(False))).drop(
        "_has", "_key", "_entry", "_hit"
    )
