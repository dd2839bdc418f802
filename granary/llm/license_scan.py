"""License scans by ordered signature rules, with DataFrame expressions only.

Rules are regexes over words joined by one space (``license_rules``).  A keyword prefilter
decides what they see: a text without any gate word of any rule is only counted; other texts
are cut into tiles of ``TILE`` words, and a tile is scanned only if a gate word stands where a
match that starts in the tile can have it.  In a tile, a rule runs only if one of its gate words
and its head word are there.  Every match has both, and no match is longer than ``REACH`` words,
so the prefilter loses nothing.  A rule is tried at every word; where it matches, the match
that the regex prefers counts.

Overlapping detections are resolved by priority and containment.  A detection goes

* if another one of at least its priority contains its words, is longer or stronger than it, or
  has the same words and comes earlier in the order of rules;
* if it overlaps one of a stronger priority.

It does not matter whether the other one goes as well, so the order of work cannot show.  A
tile also reads the words around it, as far as an overlap can reach, and each detection belongs
to the tile in which it starts: work is linear in the text however dense detections are.

Nothing is shuffled: all is one projection of a row, and ``scan`` keeps all columns of the table.

Defined results: null and empty texts have no words; texts of any length are read whole, by one
task; repeated rows are each scanned; extra columns are kept whatever their names, except that
columns called as the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.license_rules import NAMED, SURE, Rule, rules

#: Words whose detections a tile gives, and the longest match in words.
TILE, REACH = 128, 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is no part of a word, before and after A-Z are lower-cased.
_RAW_GAP, _GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def base_rules(phrases: dict[str, str]) -> list[Rule]:
    """Phrases of words and their labels as rules; the longest word, or the first of these, is the gate."""
    longest = {p: max(p.split(" "), key=len) for p in phrases}
    return [Rule(label, NAMED, (longest[p],), longest[p], p, True) for p, label in phrases.items()]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rules_sql(known: list[Rule]) -> str:
    """The rules as a constant array of structs."""
    rows = []
    for i, r in enumerate(known):
        gates = ", ".join(_quoted(f" {g} ") for g in r.gates)
        rows.append(f"named_struct('rule', {i}, 'label', {_quoted(r.label)}, 'priority', {r.priority}, 'gates', array({gates}), 'head', {_quoted(f' {r.head} ')}, 'pattern', {_quoted(f'(?<= )(?=({r.pattern}) )')}, 'base', {str(r.base).lower()})")
    return "array(" + ", ".join(rows) + ")"


#: Where the words ``piece`` start and end: a marked tile, split at its marks, has after each mark what matched, then the rest.
_FOUND = """
  transform(filter(__rules, r -> contains(z.words, r.head) AND exists(r.gates, g -> contains(z.words, g))), r ->
    aggregate(
      slice(split(regexp_replace(z.words, r.pattern, '\\u0001$1\\u0002'), '\\u0001', -1), 2, 1000000),
      named_struct('at', z.first + length(regexp_replace(split(regexp_replace(z.words, r.pattern, '\\u0001$1\\u0002'), '\\u0001', 2)[0], '[^ ]+', '')) - 1,
                   'all', cast(array() as array<struct<start: int, stop: int, priority: int, rule: int, label: string, base: boolean>>)),
      (s, piece) -> named_struct(
        'at', s.at + length(regexp_replace(substring_index(piece, '\\u0002', -1), '[^ ]+', '')),
        'all', concat(s.all, array(named_struct('start', s.at, 'stop', s.at + length(regexp_replace(substring_index(piece, '\\u0002', 1), '[^ ]+', '')) + 1,
                                               'priority', r.priority, 'rule', r.rule, 'label', r.label, 'base', r.base)))),
      s -> s.all))
"""


def scan(df: DataFrame, text: str, phrases: dict[str, str], known: list[Rule] | None = None, tile: int = TILE) -> DataFrame:
    """``df`` with n_words, detections (start and stop in words, priority, rule, label, base, kept) and their gates' words dropped.

    ``phrases`` are base rules, found in all their places; ``known`` are the other rules in order.
    """
    found = [*base_rules(phrases), *(rules() if known is None else known)]
    reach = max([REACH, *(len(p.split(" ")) for p in phrases)])
    gates = sorted({g for r in found for g in r.gates})
    value = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in ("n_words", "detections")), F.regexp_count(value, F.lit(_RAW_WORD)).cast("long").alias("n_words"), F.when(value.rlike("(?i)" + "|".join(gates)), value).alias("__text"))
    lowered = F.regexp_replace(F.translate(F.col("__text"), _UPPER, _LOWER), _GAP, " ")
    rows = rows.withColumn("__words", F.split(F.trim(lowered), " ")).drop("__text")
    inside = ", ".join(_quoted(g) for g in gates)
    # Tiles in which a match that has a gate word here can start.
    hits = f"filter(sequence(0, size(__words) - 1), i -> __words[i] IN ({inside}))"
    tiles = f"array_distinct(flatten(transform({hits}, i -> sequence(greatest(0, i - {reach}) div {tile}, i div {tile}))))"
    rows = rows.withColumn("__tiles", F.expr(f"CASE WHEN __words IS NULL THEN array() ELSE {tiles} END"))
    around = f"greatest(0, t * {tile} - {reach})"
    rows = rows.withColumn("__tiles", F.expr(f"transform(__tiles, t -> named_struct('tile', t, 'first', cast({around} as int), 'words', concat(' ', array_join(slice(__words, cast({around} as int) + 1, cast((t + 1) * {tile} + 2 * {reach} - {around} as int)), ' '), ' ')))"))
    rows = rows.drop("__words").withColumn("__found", F.expr(f"transform(__tiles, z -> named_struct('tile', z.tile, 'all', flatten({_FOUND})))".replace("__rules", _rules_sql(found)))).drop("__tiles")
    inner = "e.start <= d.start AND e.stop >= d.stop AND e.priority <= d.priority AND (e.start < d.start OR e.stop > d.stop OR e.priority < d.priority OR e.rule < d.rule)"
    over = "e.start < d.stop AND e.stop > d.start AND e.priority < d.priority"
    own = f"filter(z.all, d -> d.start div {tile} = z.tile)"
    kept = f"transform({own}, d -> named_struct('start', d.start, 'stop', d.stop, 'priority', d.priority, 'rule', d.rule, 'label', d.label, 'base', d.base, 'kept', NOT exists(z.all, e -> ({inner}) OR ({over}))))"
    return rows.withColumn("detections", F.expr(f"array_sort(flatten(transform(__found, z -> {kept})))")).drop("__found")


def labelled(df: DataFrame, text: str, phrases: dict[str, str], keep: tuple[str, ...], known: list[Rule] | None = None) -> DataFrame:
    """Columns ``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections.

    Labels are those of detections that stay and of all base phrases; score is how sure the surest
    of these is.
    """
    rows = scan(df.select(*keep, F.col(text).alias("__read")), "__read", phrases, known).drop("__read")
    base = F.expr("filter(detections, d -> d.base)")
    stay = F.expr("filter(detections, d -> d.base OR d.kept)")
    starts = lambda d: F.transform(d, lambda x: x["start"].cast("long"))
    names = lambda d: F.array_join(F.array_sort(F.array_distinct(F.transform(d, lambda x: x["label"]))), ",")
    sure = F.create_map(*(F.lit(x) for pair in SURE.items() for x in pair))
    return rows.withColumns({"__base": base, "__stay": stay}).select(
        *keep, "n_words", F.size("__base").cast("long").alias("n_base"), F.array_min(starts(F.col("__base"))).alias("first_word"), F.array_max(starts(F.col("__base"))).alias("last_word"),
        names(F.col("__base")).alias("base_labels"), names(F.col("__stay")).alias("labels"),
        F.coalesce(F.element_at(sure, F.array_min(F.transform("__stay", lambda x: x["priority"]))), F.lit(0.0)).alias("score"), F.size("__stay").cast("long").alias("n_detections"),
    )
