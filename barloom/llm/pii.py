"""Surrogates for personal data, with SQL functions only.

Entities are found by one regular expression. An entity consists of atoms (a name of
given names and a family name, any other entity of itself); an atom's canonical form ignores
case or separators, so that all its spellings get the same surrogate. A surrogate is
drawn from keyed SHA-256 and keeps what tells the type: gender and script of names,
letter case, separators and country code of numbers, a card's first digit and check
digit, the kind of an address. A surrogate that two atoms share, or that is itself an
atom of the corpus, is drawn again until none is left.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import dropped, guarded, stored

KEY = "barloom"
MOST_LITERAL = 1000  # redrawn atoms that a query may hold as a literal map
ROUNDS = 8  # draws after which the formats that are not settled are permuted
STREAM = 160  # bytes of a stream; longer atoms get one for each piece of that length

_MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин|г-н"
_FEMALE = "Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Sra|Госпожа|г-жа"
_NAME = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)?"
_SECRET = r"(?i:api[_-]?key|access[_-]?key|token|secret|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_KINDS = {
    "secret": rf"(?<![\p{{L}}\p{{N}}]){_SECRET}[A-Za-z0-9_/+-]{{16,}}+(?:[A-Za-z0-9_/+.=-]*[A-Za-z0-9_/+-])?+={{0,2}}",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.){1,126}[A-Za-z]{2,63}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d)])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_FEMALE}|{_MALE})\.? {_NAME}(?: {_NAME})*+(?![\p{{L}}])",
}
PATTERN = "|".join(f"(?:{p})" for p in _KINDS.values())
#: Without this no entity can occur.
_HINT = r"[0-9@]|(?i:token|key|secret|passw)|M[rsm]|Miss|Herr|Frau|Monsieur|Madame|S[re]|Господин|Госпожа|г-"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _kind(e: str) -> str:
    """The type of an entity; '' for a long number without a card's check digit."""
    digits = f"regexp_replace({e}, '[^0-9]', '')"
    return f"""CASE WHEN {e} rlike {_quoted('^' + _SECRET)} THEN 'secret'
        WHEN contains({e}, '@') THEN 'email'
        WHEN {e} rlike {_quoted(rf'^(?:{_FEMALE})[. ]')} THEN 'name.f'
        WHEN {e} rlike {_quoted(rf'^(?:{_MALE})[. ]')} THEN 'name.m'
        WHEN {e} rlike {_quoted('^' + _KINDS['ip'] + '$')} THEN 'ip'
        WHEN {e} rlike {_quoted('^' + _KINDS['ssn'] + '$')} THEN 'ssn'
        WHEN {e} rlike {_quoted('^(?:' + _KINDS['phone'] + ')$')} THEN 'phone'
        WHEN {_let('d', digits, _luhn('d') + ' % 10 = 0')} THEN 'card' ELSE '' END"""


def _luhn(d: str, first: int = 0) -> str:
    """Luhn's sum of a string of digits; first = 1 leaves room for a check digit."""
    digit = f"cast(substr({d}, length({d}) - j + 1, 1) as int) * (1 + (j + {first + 1}) % 2)"
    return f"aggregate(sequence(1, length({d})), 0, (s, j) -> s + {digit} - CASE WHEN {digit} > 9 THEN 9 ELSE 0 END)"


def _value(e: str) -> str:
    return f"regexp_replace({e}, {_quoted('^' + _SECRET)}, '')"


def _atoms(e: str, kind: str) -> str:
    """The atoms (kind, canonical form) of an entity."""
    one = lambda k, c: f"array(named_struct('kind', {k}, 'canon', {c}))"
    words = f"split(regexp_replace({e}, '^\\\\S+ ', ''), ' ')"
    gender = f"right({kind}, 1)"
    part = f"CASE WHEN i = size(w) - 1 THEN 'family' ELSE concat('given.', {gender}) END"
    names = _let("w", words, f"transform(w, (word, i) -> named_struct('kind', {part}, 'canon', lower(word)))")
    digits = f"regexp_replace({e}, '[^0-9]', '')"
    return f"""CASE WHEN {kind} LIKE 'name%' THEN {names}
        WHEN {kind} IN ('phone', 'card', 'ssn') THEN {one(kind, f"concat(CASE WHEN {kind} = 'phone' THEN concat(regexp_extract({e}, '^[+]([0-9]+)', 1), '+') ELSE '' END, {digits})")}
        WHEN {kind} = 'email' THEN {one(kind, f"lower({e})")}
        WHEN {kind} = 'secret' THEN {one(kind, _value(e))}
        WHEN {kind} = 'ip' THEN {one(kind, e)} ELSE array() END"""


def _stream(key: str, kind: str, canon: str, attempt: str) -> str:
    """320 hexadecimal characters that depend on the key and the atom."""
    part = lambda n: f"sha2(concat_ws('|', {_quoted(key)}, {kind}, {canon}, {attempt}, '{n}'), 256)"
    return f"concat({', '.join(part(n) for n in range(5))})"


def _byte(st: str, i: str) -> str:
    return f"cast(conv(substr({st}, 2 * (({i}) % {STREAM}) + 1, 2), 16, 10) as int)"


def _mapped(text: str, st: str) -> str:
    """Each letter becomes one of its script and case, each digit a digit.

    The first STREAM characters take their bytes from st, each further piece of that
    length from a stream of its own, derived from st and the piece's number.
    """
    b = _byte("own", "i")
    latin, hexa, russian = (f"substr('{a}', {b} % {len(a)} + 1, 1)" for a in ("abcdefghijklmnopqrstuvwxyz", "abcdef", "абвгдежзиклмнопрстуфхцчшыэюя"))
    small = f"CASE WHEN hexed THEN {hexa} WHEN lower(c) rlike '^[а-яё]$' THEN {russian} ELSE {latin} END"
    each = f"""CASE WHEN c rlike '^[0-9]$' THEN cast({b} % 10 as string)
        WHEN c rlike '^\\\\p{{Lu}}$' THEN upper({small}) WHEN c rlike '^\\\\p{{L}}$' THEN {small} ELSE c END"""
    inner = f"array_join(transform(sequence(1, length(t)), i -> {_let('c', 'substr(t, i, 1)', each)}), '')"
    further = f"concat({', '.join(f"sha2(concat_ws('|', {st}, p, '{n}'), 256)" for n in range(5))})"
    piece = _let("own", f"CASE WHEN p = 0 THEN {st} ELSE {further} END", inner)
    pieces = f"array_join(transform(regexp_extract_all(whole, '(?s).{{1,{STREAM}}}', 0), (t, p) -> {piece}), '')"
    return _let("whole", text, _let("hexed", "whole rlike '^([0-9a-f]{16,}|[0-9A-F]{16,})$'", pieces))


def _syllables(st: str, n: int, at: int, cyrillic: str) -> str:
    pair = lambda k, c, v: f"substr('{c}', {_byte(st, str(at + 2 * k))} % {len(c)} + 1, 1), substr('{v}', {_byte(st, str(at + 2 * k + 1))} % {len(v)} + 1, 1)"
    latin = ", ".join(pair(k, "bdfgklmnprstvz", "aeiou") for k in range(n))
    russian = ", ".join(pair(k, "бвгдзклмнпрст", "аеиоу") for k in range(n))
    return f"CASE WHEN {cyrillic} THEN concat({russian}) ELSE concat({latin}) END"


def _step(key: str, label: str, before: str, values: int) -> str:
    """1 to values - 1, as far as what stands before says."""
    return f"(1 + cast(conv(substr(sha2(concat_ws('|', {_quoted(key)}, {label}, {before}), 256), 1, 8), 16, 10) as bigint) % {values - 1})"


def _permuted(digits: str, key: str, label: str) -> str:
    """A keyed permutation of the strings of as many digits that leaves none in its place.

    A digit moves by a step that depends on the digits before it, which can be told from
    the result one by one.
    """
    each = f"cast((cast(substr(d, i, 1) as int) + {_step(key, label, 'left(d, i - 1)', 10)}) % 10 as string)"
    return _let("d", digits, f"array_join(transform(sequence(1, length(d)), i -> {each}), '')")


def _format(kind: str, canon: str) -> str:
    """What numbers and addresses keep; '' for atoms whose surrogates can grow."""
    return f"""CASE WHEN {kind} = 'phone' THEN concat(regexp_extract({canon}, '^[0-9]*[+]', 0), length({canon})) WHEN {kind} = 'ssn' THEN 'ssn'
        WHEN {kind} = 'card' THEN concat(left({canon}, 1), '.', length({canon})) WHEN {kind} = 'ip' THEN concat('ip', {_private(canon)}) ELSE '' END"""


def _private(canon: str) -> str:
    return f"regexp_extract({canon}, '^(10[.]|192[.]168[.]|127[.])', 1)"


def _moved(kind: str, canon: str, key: str) -> str:
    """The canonical form of a number's or address's surrogate by the permutation of its format."""
    label = f"concat({kind}, {_format(kind, canon)})"
    code, prefix = f"regexp_extract({canon}, '^([0-9]+)[+]', 1)", f"regexp_extract({canon}, '^[0-9]*[+]', 0)"
    national = f"substr({canon}, length({prefix}) + length({code}) + 1)"
    number = f"concat({code}, {_permuted(national, key, label)})"
    card = _let("p", f"concat(left({canon}, 1), {_permuted(f'substr({canon}, 2, length({canon}) - 2)', key, label)})", f"concat(p, cast((10 - {_luhn('p', 1)} % 10) % 10 as string))")
    octets = f"split(substr({canon}, length({_private(canon)}) + 1), '[.]')"
    each = f"cast((cast(octet as int) + {_step(key, label, "array_join(slice(o, 1, i), '.')", 256)}) % 256 as string)"
    ip = _let("o", octets, f"concat({_private(canon)}, array_join(transform(o, (octet, i) -> {each}), '.'))")
    return f"CASE WHEN {kind} IN ('phone', 'ssn') THEN {number} WHEN {kind} = 'card' THEN {card} ELSE {ip} END"


def _drawn(kind: str, canon: str, st: str, attempt: str, key: str) -> str:
    """The canonical form of an atom's surrogate in an attempt; -1 is the permutation of its format."""
    number = _let("code", f"regexp_extract({canon}, '^([0-9]+)[+]', 1)", f"concat(code, array_join(transform(sequence(1, length({canon}) - length(regexp_extract({canon}, '^[0-9]*[+]', 0)) - length(code)), i -> cast(CASE WHEN i = 1 THEN 2 + {_byte(st, 'i')} % 8 ELSE {_byte(st, 'i')} % 10 END as string)), ''))")
    card = _let("p", f"concat(left({canon}, 1), array_join(transform(sequence(2, length({canon}) - 1), i -> cast({_byte(st, 'i')} % 10 as string)), ''))", f"concat(p, cast((10 - {_luhn('p', 1)} % 10) % 10 as string))")
    ip = _let("head", _private(canon), f"concat(head, array_join(transform(sequence(1 + length(head) - length(replace(head, '.', '')), 4), i -> cast(CASE WHEN i = 1 THEN 11 + {_byte(st, 'i')} % 100 ELSE 1 + {_byte(st, 'i')} % 254 END as string)), '.'))")
    cyrillic = f"{canon} rlike '[а-яё]'"

    def more(letters: str, at: int) -> str:
        """A letter more for each attempt after the second."""
        one = f"substr('{letters}', {_byte(st, f'{at} + i')} % {len(letters)} + 1, 1)"
        return f"CASE WHEN {attempt} > 2 THEN array_join(transform(sequence(1, {attempt} - 2), i -> {one}), '') ELSE '' END"

    longer = f"CASE WHEN {cyrillic} THEN {more('аеиоубвгдзклмн', 40)} ELSE {more('aeioubdfgklmnprstvz', 40)} END"
    given = f"concat({_syllables(st, 3, 0, cyrillic)}, {longer}, CASE WHEN {kind} = 'given.f' THEN CASE WHEN {cyrillic} THEN 'на' ELSE 'na' END WHEN {cyrillic} THEN 'н' ELSE 'n' END)"
    family = f"concat({_syllables(st, 5, 20, cyrillic)}, {longer}, CASE WHEN {cyrillic} THEN CASE WHEN {canon} LIKE '%а' THEN 'ва' ELSE 'в' END ELSE 's' END)"
    box = _let("m", _mapped(f"regexp_extract({canon}, '^(.*[.])[^.]*$', 1)", st), f"concat(substring_index(m, '@', 1), {more('abcdefghijklmnopqrstuvwxyz', 100)}, '@', substring_index(m, '@', -1))")
    return f"""CASE WHEN {attempt} < 0 THEN {_moved(kind, canon, key)}
        WHEN {kind} IN ('phone', 'ssn') THEN {number} WHEN {kind} = 'card' THEN {card} WHEN {kind} = 'ip' THEN {ip}
        WHEN {kind} = 'email' THEN concat({box}, regexp_extract({canon}, '[^.]*$', 0))
        WHEN {kind} LIKE 'given%' THEN {given} WHEN {kind} = 'family' THEN {family} ELSE {_mapped(canon, st)} END"""


def _laid(e: str, digits: str) -> str:
    """digits in the places of an entity's digits."""
    return f"""aggregate(transform(sequence(1, length({e})), i -> substr({e}, i, 1)), named_struct('o', '', 'k', 1),
        (s, c) -> CASE WHEN c rlike '^[0-9]$' THEN named_struct('o', concat(s.o, substr({digits}, s.k, 1)), 'k', s.k + 1) ELSE named_struct('o', concat(s.o, c), 'k', s.k) END, s -> s.o)"""


def _cased(e: str, name: str) -> str:
    return f"CASE WHEN {e} = upper({e}) AND length({e}) > 1 THEN upper({name}) ELSE initcap({name}) END"


def _surrogate(e: str, kind: str, atoms: str, drawn: str) -> str:
    """An entity's replacement, from the surrogates of its atoms."""
    title = f"regexp_extract({e}, '^\\\\S+ ', 0)"
    words = f"split(substr({e}, length({title}) + 1), ' ')"
    names = _let("w", words, f"concat({title}, array_join(transform({drawn}, (n, i) -> {_cased('w[i]', 'n')}), ' '))")
    case_kept = f"array_join(transform(sequence(1, length({drawn}[0])), i -> CASE WHEN substr({e}, i, 1) rlike '^\\\\p{{Lu}}$' THEN upper(substr({drawn}[0], i, 1)) ELSE substr({drawn}[0], i, 1) END), '')"
    return f"""CASE WHEN {kind} LIKE 'name%' THEN {names} WHEN {kind} IN ('phone', 'card', 'ssn') THEN {_laid(e, f'{drawn}[0]')}
        WHEN {kind} = 'secret' THEN concat(left({e}, length({e}) - length({drawn}[0])), {drawn}[0])
        WHEN {kind} = 'email' THEN {case_kept} WHEN {kind} = 'ip' THEN {drawn}[0] ELSE {e} END"""


def with_entities(docs: DataFrame) -> DataFrame:
    """Add __entities: value, kind and atoms of each match in order."""
    found = f"CASE WHEN text rlike {_quoted(_HINT)} THEN regexp_extract_all(text, {_quoted(PATTERN)}, 0) ELSE array() END"
    kinds = f"transform({found}, e -> named_struct('value', e, 'kind', {_kind('e')}))"
    return docs.withColumn("__entities", F.expr(f"transform({kinds}, x -> named_struct('value', x.value, 'kind', x.kind, 'atoms', {_atoms('x.value', 'x.kind')}))"))


def redrawn(found: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """Atoms (kind, canon) whose first surrogate did not stay, and the attempt that did.

    After rounds the formats of numbers and addresses that are not settled are permuted
    (attempt -1); surrogates that can grow are drawn until none is shared.
    """
    atoms = found.select(F.explode("__entities").alias("e")).select(F.explode("e.atoms").alias("a")).select("a.kind", "a.canon").distinct()
    now = stored(atoms.withColumns({"attempt": F.lit(0), "format": F.expr(_format("kind", "canon"))}).withColumn("drawn", F.expr(_drawn_at(key))), "atoms")
    for turn in itertools.count():
        real = now.select(F.col("kind").alias("k"), F.regexp_replace("canon", "^[0-9]*[+]", "").alias("c")).distinct()
        twice = now.withColumn("nth", F.expr("row_number() over (partition by kind, format, drawn order by canon)"))
        marked = twice.join(real, (F.col("kind") == F.col("k")) & (F.col("drawn") == F.col("c")), "left")
        bad = ((F.col("nth") > 1) | F.col("c").isNotNull()) & (F.col("attempt") >= 0)
        new = marked.select("kind", "canon", "format", (F.col("attempt") + bad.cast("int")).alias("attempt"), bad.alias("bad"))
        if turn >= rounds:
            tight = stored(new.filter("bad and format <> ''").select("kind", "format").distinct().withColumn("tight", F.lit(True)), "tight")
            new = new.join(tight, ["kind", "format"], "left").withColumn("attempt", F.when(F.col("tight"), -1).otherwise(F.col("attempt"))).drop("tight")
        new = stored(new.withColumn("drawn", F.expr(_drawn_at(key))), "atoms")
        left = new.filter("bad").count()
        dropped(now.sparkSession, now)
        now = new.drop("bad")
        if not left:
            return now.filter("attempt <> 0").select("kind", "canon", "attempt")


def _drawn_at(key: str) -> str:
    return _let("st", _stream(key, "kind", "canon", "cast(attempt as string)"), _drawn("kind", "canon", "st", "attempt", key))


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with entities in text replaced and a column __entities (see with_entities).

    A null text stays null, an empty one empty; repeated rows and equal entities get
    equal surrogates everywhere; other columns stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    found = with_entities(docs)
    again = stored(redrawn(with_entities(docs.select("text").filter(F.col("text").rlike(_HINT))), key), "redrawn")
    many = again.count()
    if many == 0:
        attempt = "0"
    elif many <= MOST_LITERAL:
        pairs = [F.lit(x) for r in again.collect() for x in (f"{r.kind}|{r.canon}", r.attempt)]
        found = found.withColumn("__attempts", F.create_map(*pairs))
        attempt = "coalesce(try_element_at(__attempts, concat(a.kind, '|', a.canon)), 0)"
    else:
        at = found.select(F.xxhash64("text").alias("__key"), F.sha2("text", 256).alias("__sum"), F.explode("__entities").alias("e")).select("__key", "__sum", F.explode("e.atoms").alias("a"))
        maps = at.select("__key", "__sum", "a.kind", "a.canon").distinct().join(again, ["kind", "canon"]).groupBy("__key", "__sum").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("__attempts"))
        found = found.withColumns({"__key": F.xxhash64("text"), "__sum": F.sha2("text", 256)}).join(maps, ["__key", "__sum"], "left").drop("__key", "__sum")
        attempt = "coalesce(try_element_at(__attempts, concat(a.kind, '|', a.canon)), 0)"
    draw = _let("st", _stream(key, "a.kind", "a.canon", "cast(n as string)"), _drawn("a.kind", "a.canon", "st", "n", key))
    draw = _let("n", attempt, draw)
    one = _let("drawn", f"transform(x.atoms, a -> {draw})", _surrogate("x.value", "x.kind", "x.atoms", "drawn"))
    new = f"transform(__entities, x -> {one})"
    text = f"CASE WHEN size(__entities) = 0 OR text IS NULL THEN text ELSE array_join(zip_with(split(text, {_quoted(PATTERN)}, -1), {new}, (g, s) -> concat(g, coalesce(s, ''))), '') END"
    out = found.withColumn("text", F.expr(text))
    return out.select(*docs.columns, "__entities")


def surrogate_report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, n_entities, kinds (sorted, joined by commas) and the new text."""
    out = pseudonymised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
    kept = F.filter("__entities", lambda e: e["kind"] != "")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(kept, lambda e: F.substring_index(e["kind"], ".", 1)))), ",")
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(kept)).cast("long").alias("n_entities"), F.coalesce(kinds, F.lit("")).alias("kinds"), "text")


def without_personal_data(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with surrogates in text; rows and all other columns stay, whatever their names.

    Null and empty texts stay as they are; an empty table gives no rows.
    """
    return guarded(docs, lambda rows: pseudonymised(rows, key).select(*rows.columns))
