"""Problem 4: mapping freely typed values to a canonical list, in SQL only.

Pigeonhole join. Labels are reduced to distinct ones, then to a few readings each (without a bracketed
note, before or behind a comma, in turned order, without a framing phrase), spelled in full and without
anything but letters and digits. A canonical name for which k edits are allowed is cut into k + 1
segments; a reading within k edits holds at least one segment i unchanged with at most i edits before it and k - i behind it.
So the segment stands at most i places away, and with a difference of lengths d at most k - i from d places away; for each d
and each of these places there is a row of (segment, numbers, place, length), which readings meet in an equality join on all four,
and the built-in ``levenshtein`` decides. Nothing but the join of equal keys makes pairs. The nearest entry wins, of several as near the one with the
longest name; what ties even so is left unmapped. An anti-join reports what no entry is near to. Labels that many rows share are
dealt to several tasks.

Numbers are part of a name ("Orbel 8", "Orbel 16") and have to agree. Readings longer than the longest
name plus its edits can't match, so they are dropped before substrings are made.

Defined cases: null, blank and meaningless labels give ``NONE``; names as short as four characters match
only as they are; several entries with the same name are a tie; repeated rows keep their own
``mapping_id``, rows without one aren't reported; other columns are ignored; an empty list gives ``NONE`` for every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.plans.skew import HOT_ROWS

#: Letters with marks and their base letters: fixed values.
MARKED = "áàâäãåāăąéèêëēėęěíìîïīįıóòôöõøōőúùûüūůűųýÿçćčñńňšśşžźżğłđťřďľĺŕ"
PLAIN = "aaaaaaaaaeeeeeeeeiiiiiiioooooooouuuuuuuuyycccnnnssszzzgldtrdllr"
#: Short forms of words in titles and names: fixed values.
SHORT_FORMS = {
    "dir": "director", "dsgnr": "designer", "des": "designer", "eng": "engineer", "engr": "engineer", "prog": "programmer",
    "mgr": "manager", "tech": "technical", "mktg": "marketing", "asst": "assistant", "assoc": "associate", "lvl": "level",
    "transl": "translator", "netw": "network", "int": "interactive", "pt": "port", "n": "new", "mocap": "motioncapture",
    "qa": "qualityassurance", "ui": "userinterface", "localization": "localisation", "loc": "localisation", "rec": "records",
    "exec": "executive", "prod": "producer", "anim": "animator", "narr": "narrative", "comm": "community", "edtr": "editor",
    "mod": "moderator", "illus": "illustrator", "techn": "technician", "ed": "editor", "sr": "senior",
    "char": "character", "bros": "brothers",
}
#: Words that frame a value without being part of it: fixed values.
BEFORE = r"^(?:the |a |an |work as |works as |working as |worked as |job: |freelance |former |near the docks,? |city of |town of )+"
BEHIND = r"(?: at .*| console| [0-9][0-9][0-9][0-9][0-9]?|,? [0-9]+ ?- ?[0-9]+|,? since [0-9]+)$"


def allowed(length: str) -> str:
    """SQL: the edits allowed for a name of so many characters."""
    return f"CASE WHEN {length} <= 4 THEN 0 WHEN {length} <= 6 THEN 1 WHEN {length} <= 9 THEN 2 WHEN {length} <= 13 THEN 3 ELSE 4 END"


def _wider(k: str) -> str:
    """SQL: the edits allowed where the letters are the same but for one: a swap of two letters is two edits."""
    return f"CASE WHEN {k} = 0 THEN 0 ELSE {k} + 1 END"


def _sorted(x: str, duck: bool) -> str:
    return f"array_to_string(list_sort(string_split({x}, '')), '')" if duck else f"array_join(array_sort(split({x}, '')), '')"


def _replace(x: str, pattern: str, by: str, duck: bool) -> str:
    pattern = pattern if duck else pattern.replace("\\", "\\\\")
    return f"regexp_replace({x}, '{pattern}', '{by}'" + (", 'g')" if duck else ")")


def _group(n: int, duck: bool) -> str:
    return f"\\{n}" if duck else f"${n}"


def _base(x: str, duck: bool) -> str:
    """Lower case without marks and signs, digits typed for letters put right, one space between words."""
    out = f"translate(lower({x}), '{MARKED}', '{PLAIN}')"
    out = _replace(out, "[®™©\"“”]", " ", duck)
    out = _replace(out, "([a-z])0([a-z])", f"{_group(1, duck)}o{_group(2, duck)}", duck)
    out = _replace(out, "([a-z])1([a-z])", f"{_group(1, duck)}l{_group(2, duck)}", duck)
    out = _replace(out, r"([a-z])([0-9])", f"{_group(1, duck)} {_group(2, duck)}", duck)
    out = _replace(out, r"[\s_]+", " ", duck)
    return f"trim({out})"


def _full(x: str, duck: bool) -> str:
    """A reading in full: framing phrases away, words spelled out, only letters and digits."""
    x = _replace(x, r"[\s.;:!?,]+$", "", duck)
    x = f"trim({_replace(f'trim({x})', BEHIND, '', duck)})"
    x = f"trim({_replace(x, BEFORE, '', duck)})"
    x = f"trim({_replace(x, '[^a-z0-9]+', ' ', duck)})"
    words = f"string_split({x}, ' ')" if duck else f"split({x}, ' ')"
    keys, values = (", ".join(f"'{v}'" for v in side) for side in (SHORT_FORMS, SHORT_FORMS.values()))
    if duck:
        return f"array_to_string(list_transform({words}, lambda w: coalesce(map([{keys}], [{values}])[w], w)), '')"
    pairs = f"map_from_arrays(array({keys}), array({values}))"
    return f"array_join(transform({words}, w -> coalesce(element_at({pairs}, w), w)), '')"


def _readings(base: str, duck: bool) -> str:
    """SQL array of the readings of a base form."""
    bare = _replace(base, r" *[\(\[][^\)\]]*[\)\]]", "", duck)
    part = lambda n: f"split_part({bare}, ',', {n})"
    has = f"instr({bare}, ',') > 0"
    some = [_full(base, duck), _full(bare, duck), *(f"CASE WHEN {has} THEN {_full(x, duck)} END" for x in (part(1), part(2), f"concat({part(2)}, ' ', {part(1)})"))]
    return ("[" if duck else "array(") + ", ".join(some) + ("]" if duck else ")")


def _numbers(x: str, duck: bool) -> str:
    return _replace(x, "[^0-9]", "", duck)


def mapped(mapping: DataFrame, canonical: DataFrame) -> DataFrame:
    """(mapping_id, wikidata_qid) of each ``typed_value`` row; ``NONE`` where no entry is near."""
    sql = mapping.sparkSession.sql
    typed = sql("SELECT mapping_id, label FROM {m} WHERE status = 'typed_value' AND mapping_id IS NOT NULL", m=mapping)
    labels = sql("SELECT label, count(*) AS rows FROM {t} WHERE label IS NOT NULL GROUP BY label", t=typed)
    names = sql(
        f"""WITH n AS (
              SELECT wikidata_qid AS qid, explode(array_append(coalesce(split(also_known_as, '[|]'), array()), wikidata_label)) AS name FROM {{c}}
              WHERE wikidata_qid IS NOT NULL),
            f AS (SELECT DISTINCT qid, {_full(_base("name", False), False)} AS name FROM n WHERE name IS NOT NULL)
            SELECT *, {_wider("k")} AS kk FROM (
              SELECT qid, name, length(name) AS len, {allowed("length(name)")} AS k, {_numbers("name", False)} AS num FROM f WHERE name <> '')""",
        c=canonical,
    )
    segments = sql(
        """WITH s AS (SELECT *, i * len DIV (kk + 1) AS at, substring(name, i * len DIV (kk + 1) + 1, (i + 1) * len DIV (kk + 1) - i * len DIV (kk + 1)) AS seg
                    FROM (SELECT *, explode(sequence(0, kk)) AS i FROM {n})),
             d AS (SELECT *, explode(sequence(-kk, kk)) AS d FROM s),
             p AS (SELECT *, greatest(-i, d - (kk - i)) AS first, least(i, d + (kk - i)) AS last FROM d)
           SELECT qid, name, k, kk, len, num, seg, len + d AS other, explode(sequence(at + first, at + last)) AS at FROM p WHERE first <= last""",
        n=names,
    )
    readings = sql(
        f"""SELECT DISTINCT label, r, length(r) AS len, {_numbers("r", False)} AS num
            FROM (SELECT label, explode({_readings(_base("label", False), False)}) AS r FROM {{l}}) WHERE r <> ''""",
        l=labels,
    )
    # distinct readings meet distinct segments; the lengths of segments are few, so substrings are made of those lengths only
    found = sql(
        f"""WITH d AS (SELECT DISTINCT r, len, num FROM {{r}}),
             s AS (SELECT DISTINCT length(seg) AS w FROM {{s}}),
             w AS (SELECT collect_set(w) AS ws FROM s),
             m AS (SELECT max(other) AS longest FROM {{s}}),
             x AS (SELECT r, len, num, explode((SELECT ws FROM w)) AS w FROM d WHERE len <= (SELECT longest FROM m)),
             y AS (SELECT r, len, num, at, substring(r, at + 1, w) AS seg FROM (SELECT *, explode(sequence(0, len - w)) AS at FROM x WHERE w <= len)),
             p AS (SELECT DISTINCT y.r, s.qid, s.name, s.k, s.kk FROM y JOIN {{s}} s ON y.seg = s.seg AND y.num = s.num AND y.at = s.at AND y.len = s.other),
             v AS (SELECT r, qid, name, k, levenshtein(r, name, kk) AS dist FROM p)
           SELECT r, qid, min(struct(dist, -length(name) AS len)) AS near FROM v
           WHERE dist >= 0 AND (dist <= k OR levenshtein({_sorted("r", False)}, {_sorted("name", False)}, 1) >= 0) GROUP BY r, qid""",
        r=readings,
        s=segments,
    )
    best = sql(
        """WITH b AS (SELECT q.label, f.qid, min(f.near) AS near FROM {r} q JOIN {f} f ON q.r = f.r GROUP BY q.label, f.qid),
             t AS (SELECT label, min(near) AS nearest, collect_list(struct(near, qid)) AS all FROM b GROUP BY label)
           SELECT label, all[0].qid AS qid FROM (SELECT label, filter(all, x -> x.near = nearest) AS all FROM t) WHERE size(all) = 1""",
        r=readings,
        f=found,
    )
    # labels from HOT_ROWS rows on: one copy of the answer for each HOT_ROWS rows; the list of them has at most rows / HOT_ROWS entries
    hit = sql(
        f"""WITH known AS (SELECT b.label, b.qid, cast(ceil(l.rows / {HOT_ROWS}) AS int) AS copies FROM {{l}} l JOIN {{b}} b ON l.label = b.label),
             many AS (SELECT label, copies FROM known WHERE copies > 1),
             dealt AS (SELECT /*+ BROADCAST(h) */ t.mapping_id, t.label, CASE WHEN h.copies IS NULL THEN 0 ELSE cast(pmod(xxhash64(t.mapping_id), h.copies) AS int) END AS salt
                       FROM {{t}} t LEFT JOIN many h ON t.label = h.label),
             answers AS (SELECT label, qid, explode(sequence(0, copies - 1)) AS salt FROM known)
           SELECT d.mapping_id, a.qid AS wikidata_qid FROM dealt d JOIN answers a ON d.label = a.label AND d.salt = a.salt""",
        l=labels,
        b=best,
        t=typed,
    )
    return sql(
        """SELECT DISTINCT mapping_id, wikidata_qid FROM {h}
           UNION ALL SELECT DISTINCT t.mapping_id, 'NONE' FROM {t} t LEFT ANTI JOIN {h} h ON t.mapping_id = h.mapping_id""",
        t=typed,
        h=hit,
    )


FOUND_SQL = f"""
WITH n AS (
  SELECT wikidata_qid AS qid, unnest(list_append(coalesce(string_split(also_known_as, '|'), []), wikidata_label)) AS name FROM canonical_values
), nf AS (SELECT DISTINCT qid, {_full(_base("name", True), True)} AS name FROM n WHERE name IS NOT NULL),
nn AS (SELECT *, {_wider("k")} AS kk FROM (SELECT qid, name, {allowed("length(name)")} AS k, {_numbers("name", True)} AS num FROM nf WHERE name <> '')),
l AS (SELECT DISTINCT label FROM entity_mapping WHERE status = 'typed_value' AND label IS NOT NULL),
r AS (SELECT DISTINCT label, r, {_numbers("r", True)} AS num FROM (SELECT label, unnest({_readings(_base("label", True), True)}) AS r FROM l) WHERE r <> ''),
b AS (SELECT label, qid, min(levenshtein(r, name) * 1000 - length(name)) AS dist FROM r JOIN nn USING (num) WHERE abs(length(r) - length(name)) <= kk AND levenshtein(r, name) <= kk
  AND (levenshtein(r, name) <= k OR levenshtein({_sorted("r", True)}, {_sorted("name", True)}) <= 1) GROUP BY label, qid),
t AS (SELECT label, qid, count(*) OVER (PARTITION BY label, dist) AS ties, dist = min(dist) OVER (PARTITION BY label) AS best FROM b)
SELECT DISTINCT e.mapping_id, coalesce(t.qid, 'NONE') AS wikidata_qid
FROM entity_mapping e LEFT JOIN (SELECT label, qid FROM t WHERE best AND ties = 1) t ON e.label = t.label
WHERE e.status = 'typed_value'
"""
