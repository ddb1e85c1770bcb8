"""PII surrogates in DataFrame functions only: keyed, type-consistent, distinct, coreferent.

Entities are found by one alternation of patterns.  Each has a type and a canonical form (a phone's
digits, a lower-cased address, each word of a name); the surrogate of a canonical form is spelled from
SHA-256(key, type, form, attempt), so every mention, however formatted, gets the same replacement:
digits become digits, letters letters of the same script and case, punctuation stays, an IP's octets
stay octets, a card that passes its check digit still does, a name keeps its titles.

Names: a word's surrogate depends on key, script and word alone, so a person keeps it under any title, in any
document.  The ending is chosen per document: a given name's by the gender that its titles there tell, a surname's by
the word's own gendered ending (Cyrillic, Greek).  Words known from a titled name are replaced in the
rest of the document too, wherever they stand capitalised without a title.

The key is required; ``session_key`` reads it from the session, or draws one for the session.

Collision check: all distinct forms of the corpus are grouped; a form whose surrogate is taken by a
smaller form of its type, or is itself a form of the corpus, moves to its next attempt, until none is
left.  Only forms that moved travel back to the documents.

Scale: texts are rewritten in place by row expressions, without shuffle; the shuffled part is the distinct
forms.  Forms that moved are joined to the documents that mention them; their table is broadcast only
within a measured bound.  A mention shared by a third of the rows is merged on the map side.

Defined cases: a null text stays null with no entities; empty texts stay; repeated rows are rewritten
alike; a null doc_id is carried; an empty table gives an empty result; extra columns of any name stay.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import BROADCAST_BYTES, stored, table

# Titles by gender, and the letters and endings surrogates are spelled with, by script.
TITLES_F = "Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mademoiselle|Signora|Госпожа|Κυρία"
TITLES_M = "Mr|Herr|Señor|Monsieur|Signor|Господин|Κύριος"
TITLES_N = "Dr|Prof|Doctor|Professor|Mx|Rev|Доктор|Профессор|Δρ"
TITLE = rf"(?:(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\.? )"
SYLLABLES = {
    "latin": ("b d f g k l m n p r s t v z br tr", "a e i o u ai ei ou"),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х", "а е и о у ы ю я"),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ ψ", "α ε η ι ο υ ω αι"),
}
GIVEN_END = {("latin", "f"): "a", ("latin", "m"): "n", ("cyrillic", "f"): "на", ("cyrillic", "m"): "н",
             ("greek", "f"): "α", ("greek", "m"): "ος", ("latin", "n"): "i", ("cyrillic", "n"): "и", ("greek", "n"): "ι"}
SURNAME_END = {("latin", "f"): "l", ("latin", "m"): "l", ("cyrillic", "f"): "ова", ("cyrillic", "m"): "ов",
               ("greek", "f"): "ου", ("greek", "m"): "ης", ("latin", "n"): "l", ("cyrillic", "n"): "ко", ("greek", "n"): "ας"}
# Surnames that tell their bearer's gender: script, endings of women's and of men's.
OWN_GENDER = (("cyrillic", r"(?:[оеё]ва|ина|ына|ая)\z", r"(?:[оеё]в|ин|ын|ий|ый|ой)\z"), ("greek", r"ου\z", r"[ηοα]ς\z"))
OTHER_LATIN = "àâäçéèêëîïôöùûüñß"
# Letters and signs of scripts without names above; those of any further script become a-z, other numerals 0-9.
ALPHABETS = {
    "Han": "".join(chr(0x4E00 + 81 * k) for k in range(256)), "Hangul": "".join(chr(0xAC00 + 43 * k) for k in range(256)),
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Devanagari": "अआइईउऊएओकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह", "Thai": "กขคงจฉชซญดตถทนบปผพฟภมยรลวสหอ",
}
CROWDED = 8                  # from this attempt on, a surrogate of fixed length grows too

# A name word is read to its last letter, whatever capitals, apostrophes and hyphens it holds; a possessive 's is not part of it.
NAME = r"\p{Lu}\p{M}*+(?:(?!['’]s(?![\p{L}\p{M}]))['’\-]?[\p{L}\p{M}])++"
PATTERNS = [
    ("EMAIL", r"(?<![\p{L}\p{M}\p{N}._%+\-])[\p{L}\p{M}\p{N}._%+\-]++@[\p{L}\p{M}\p{N}\-]++(?:\.[\p{L}\p{M}\p{N}\-]++)+"),
    ("TOKEN", r"(?<![\p{L}\p{N}_])(?:[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![\p{L}\p{N}_])"),
    ("IBAN", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("IP", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"),
    ("PHONE", r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)"
              r"|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)"
              r"|(?<![\p{L}\p{N}+.\-])\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\d\-])"),
    ("SSN", r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])"),
    ("CARD", r"(?<![\p{L}\p{N}.\-])\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}])"),
    ("PERSON", rf"(?<!\p{{L}}){TITLE}++{NAME}(?: (?!{TITLE}){NAME}){{0,2}}"),
]
ENTITY = "|".join(f"(?:{p})" for _, p in PATTERNS)
BARE = rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){NAME}"
HINT = rf"[0-9@]|{TITLE}\p{{Lu}}"
SEP = "\x1f"
KEY_SETTING = "spark.sifter.pii.key"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def entities(text: Column) -> Column:
    """Entities of a text in order; texts without a digit, an @ or a title are passed over."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entity_type(e: Column) -> Column:
    out = F.lit("PERSON")
    for name, pattern in reversed(PATTERNS[:-1]):
        out = F.when(e.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(out)
    return out


def person_parts(e: Column) -> tuple[Column, Column, Column]:
    """(titles with their trailing blank, name words, gender) of a PERSON entity."""
    title = F.regexp_extract(e, rf"\A{TITLE}++", 0)
    names = F.split(F.substr(e, F.char_length(title) + 1), " ")
    has = lambda titles: title.rlike(rf"(?<!\p{{L}})(?:{titles})\.? ")
    return title, names, F.when(has(TITLES_F), F.lit("f")).when(has(TITLES_M), F.lit("m")).otherwise(F.lit("n"))


def name_form(word: Column) -> Column:
    """A name word whatever its case and apostrophe."""
    return F.translate(F.lower(word), "’", "'")


def script_of(word: Column) -> Column:
    return (F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(word.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin")))


def name_type(word: Column) -> Column:
    return F.concat(F.lit("NAME_"), script_of(word))


def is_person(e: Column) -> Column:
    return e.rlike(rf"\A{TITLE}")


def known_names(ents: Column) -> Column:
    """(form, gender, last) of every word of the titled names among a document's entities."""
    def of(e: Column) -> Column:
        _, names, gender = person_parts(e)
        return F.transform(names, lambda w, i: F.struct(name_form(w).alias("form"), gender.alias("gender"), (i == F.size(names) - 1).alias("last")))
    return F.flatten(F.transform(F.filter(ents, is_person), of))


def name_ending(word: Column, known: Column) -> Column:
    """The ending of a name word's surrogate, from what the document's titled names tell about it."""
    form, script = name_form(word), script_of(word)
    said = lambda test: F.exists(known, lambda k: (k["form"] == form) & test(k))
    f, m = said(lambda k: k["gender"] == "f"), said(lambda k: k["gender"] == "m")
    titles = F.when(f & ~m, F.lit("f")).when(m & ~f, F.lit("m")).otherwise(F.lit("n"))
    own = titles
    for other, pattern_f, pattern_m in OWN_GENDER:
        own = F.when(script == other, F.when(form.rlike(pattern_f), F.lit("f")).when(form.rlike(pattern_m), F.lit("m")).otherwise(titles)).otherwise(own)
    pick = lambda ends, gender: F.element_at(F.create_map(*[F.lit(x) for (s, g), end in ends.items() for x in (s + g, end)]), F.concat(script, gender))
    return F.when(said(lambda k: ~k["last"]), pick(GIVEN_END, titles)).otherwise(pick(SURNAME_END, own))


def canonical(kind: Column, e: Column) -> Column:
    """What all mentions of one entity share."""
    return (F.when(kind.isin("CARD", "SSN"), F.regexp_replace(e, r"[^0-9]", ""))
            .when(kind == "PHONE", F.regexp_replace(e, r"[^0-9+]", ""))
            .when(kind == "IBAN", F.regexp_replace(e, " ", ""))
            .when(kind == "IP", F.regexp_replace(e, r"(?<![0-9])0+(?=[0-9])", ""))
            .when(kind == "TOKEN", e).otherwise(F.lower(e)))


def units(e: Column) -> Column:
    """The (type, form) pairs of an entity: one, or one per word of a name."""
    of_names = F.transform(person_parts(e)[1], lambda w: F.struct(name_type(w).alias("kind"), name_form(w).alias("form")))
    single = _let(entity_type(e), lambda t: F.array(F.struct(t.alias("kind"), canonical(t, e).alias("form"))))
    return F.when(is_person(e), of_names).otherwise(single)


def _byte(pool: Column, i: Column) -> Column:
    return F.conv(F.substr(pool, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(c: Column, b: Column) -> Column:
    """A character of the same class as ``c`` (a canonical character), chosen by the byte ``b``."""
    at = lambda s: F.substr(F.lit(s), F.pmod(b, F.lit(len(s))) + 1, F.lit(1))
    other = F.when(c.rlike(r"[\p{L}\p{M}]"), at("abcdefghijklmnopqrstuvwxyz")).when(c.rlike(r"\p{N}"), at("0123456789")).otherwise(c)
    for script, letters in ALPHABETS.items():
        other = F.when(c.rlike(rf"(?=[\p{{L}}\p{{M}}])\p{{Is{script}}}"), at(letters)).otherwise(other)
    return (F.when(c.rlike("[0-9]"), at("0123456789")).when(c.rlike("[a-z]"), at("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), at("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"\p{IsCyrillic}"), at("абвгдежзиклмнопрстуфхцчшщэюя"))
            .when(c.rlike(r"\p{IsGreek}"), at("αβγδεζηθικλμνξοπρστυφχψω"))
            .when(c.rlike(r"\p{IsLatin}"), at(OTHER_LATIN)).otherwise(other))


def _spelled(form: Column, pool: Column, keep: Column) -> Column:
    """The form character by character, its first ``keep`` characters unchanged."""
    chars = F.transform(F.split(form, ""), lambda c, i: F.when(i < keep, c).otherwise(_letter(c, _byte(pool, i))))
    return F.array_join(chars, "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string modulo 10, counted from the right."""
    n = F.char_length(digits)
    value = lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    return F.pmod(F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, v: a + v), F.lit(10))


def _card(form: Column, pool: Column) -> Column:
    n = F.char_length(form)
    body = lambda s: F.concat(F.substr(s, F.lit(1), n - 1), F.lit("0"))
    checked = lambda s: F.concat(F.substr(s, F.lit(1), n - 1), F.pmod(10 - _luhn(body(s)), F.lit(10)).cast("string"))
    return _let(_spelled(form, pool, F.lit(0)), lambda s: F.when(_luhn(form) == 0, checked(s)).otherwise(s))


def _syllable(pool: Column, heads: Column, tails: Column):
    return lambda i: F.concat(heads[F.pmod(_byte(pool, i * 2), F.size(heads))], tails[F.pmod(_byte(pool, i * 2 + 1), F.size(tails))])


def _name(kind: Column, pool: Column, attempt: Column) -> Column:
    """The pronounceable body of a name of the kind's script, without its ending; later attempts are longer."""
    out = F.lit(None).cast("string")
    for script, (heads, tails) in SYLLABLES.items():
        heads, tails = (F.split(F.lit(x), " ") for x in (heads, tails))
        body = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), _syllable(pool, heads, tails)), "")
        out = F.when(kind == f"NAME_{script}", body).otherwise(out)
    return out


def spellings(kind: Column, s: Column) -> Column:
    """Every form that the surrogate ``s`` may be written as: a name's body with any of its script's endings."""
    out = F.array(s)
    for script in SYLLABLES:
        ends = sorted({end for ends in (GIVEN_END, SURNAME_END) for (of, _), end in ends.items() if of == script})
        out = F.when(kind == f"NAME_{script}", F.array(*[F.concat(s, F.lit(end)) for end in ends])).otherwise(out)
    return out


def surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The replacement of a canonical form, itself canonical (of a name word: its body).

    An address gets a letter more with each attempt (and one at once if it has none to replace), numbers and
    secrets from attempt ``CROWDED`` on: whatever the corpus holds, some attempt is free.
    """
    seed = F.concat_ws(SEP, F.lit(key), kind, form, attempt.cast("string"))
    pool = _let(F.sha2(seed, 256), lambda h: F.concat(h, F.sha2(h, 256)))
    octet = lambda p: lambda i: (F.pmod(_byte(p, i), F.lit(223)) + 1).cast("string")
    more = F.greatest(attempt - (CROWDED - 1), F.lit(0))
    longer = F.concat(form, F.repeat(F.lit("0"), more))
    label = F.regexp_extract(form, r"\A(.*)(\.[^.]*)\z", 1)
    bare = F.when(label.rlike(r"[\p{L}\p{M}\p{N}]"), F.lit(0)).otherwise(F.lit(1))
    label = F.concat(F.repeat(F.lit("a"), attempt + bare), label)
    top = F.regexp_extract(form, r"\A(.*)(\.[^.]*)\z", 2)
    return _let(pool, lambda p: (
        F.when(kind == "EMAIL", F.concat(_spelled(label, p, F.lit(0)), top))
        .when(kind == "IP", F.array_join(F.transform(F.sequence(F.lit(0), more + 3), octet(p)), "."))
        .when(kind == "CARD", _card(F.concat(F.repeat(F.lit("0"), more), form), p))      # zeros in front leave the check digit
        .when(kind == "PHONE", _spelled(longer, p, F.when(F.startswith(form, F.lit("+")), F.lit(2)).otherwise(F.lit(0))))
        .when(kind == "IBAN", _spelled(longer, p, F.lit(2)))
        .when(kind == "TOKEN", _token(longer, p))
        .when(kind == "SSN", _spelled(longer, p, F.lit(0)))
        .otherwise(_name(kind, p, attempt))))


def _token(form: Column, p: Column) -> Column:
    """Hexadecimal stays hexadecimal; other secrets keep their published prefix."""
    low = lambda i: F.substr(F.lit("0123456789abcdef"), F.pmod(_byte(p, i), F.lit(16)) + 1, F.lit(1))
    of_hex = F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike("[A-F]"), F.upper(low(i))).otherwise(low(i))), "")
    return F.when(form.rlike(r"\A[0-9a-fA-F]+\z"), of_hex).otherwise(_spelled(form, p, F.lit(4)))


def formatted(e: Column, form: Column) -> Column:
    """``form`` in the clothes of mention ``e``: its punctuation and its letters' case."""
    def put(acc: Column, c: Column) -> Column:
        here = F.substr(form, acc["at"], F.lit(1))
        dressed = F.when(c.rlike(r"\p{Lu}"), F.upper(here)).otherwise(here)
        return F.when(c.rlike(r"[\p{L}\p{N}+]"), F.struct((acc["at"] + 1).alias("at"), F.concat(acc["s"], dressed).alias("s"))).otherwise(
            F.struct(acc["at"].alias("at"), F.concat(acc["s"], c).alias("s")))
    return F.aggregate(F.split(e, ""), F.struct(F.lit(1).alias("at"), F.lit("").alias("s")), put,
                       lambda a: F.concat(a["s"], F.substr(form, a["at"])))


def _dress_email(e: Column, form: Column) -> Column:
    """Case by position from the end: letters that a later attempt adds stand in front."""
    ahead = F.char_length(form) - F.char_length(e)
    same = lambda i: F.when(i >= ahead, F.substr(e, i - ahead + 1, F.lit(1))).otherwise(F.lit(""))
    return F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(same(i).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")


def _new(kind: Column, form: Column, attempts: Column | None, key: str) -> Column:
    n = F.lit(0) if attempts is None else F.coalesce(attempts[F.concat_ws(SEP, kind, form)], F.lit(0))
    return surrogate(kind, form, n, key)


def new_name(word: Column, known: Column, attempts: Column | None, key: str) -> Column:
    """The surrogate of a name word, with its ending in this document."""
    return F.initcap(F.concat(_new(name_type(word), name_form(word), attempts, key), name_ending(word, known)))


def replacement(e: Column, known: Column, attempts: Column | None, key: str) -> Column:
    """The surrogate of mention ``e``; ``attempts`` maps type + form to an attempt above 0."""
    title, names, _ = person_parts(e)
    person = F.concat(title, F.array_join(F.transform(names, lambda w: new_name(w, known, attempts, key)), " "))
    other = lambda t: _let(_new(t, canonical(t, e), attempts, key), lambda s: (
        F.when(t == "EMAIL", _dress_email(e, s)).when(t.isin("IP", "TOKEN"), s).otherwise(formatted(e, s))))
    return F.when(is_person(e), person).otherwise(_let(entity_type(e), other))


def untitled(gap: Column, known: Column, attempts: Column | None, key: str) -> Column:
    """A piece between entities with the known names in it replaced."""
    word = lambda w: F.when(F.exists(known, lambda k: k["form"] == name_form(w)), new_name(w, known, attempts, key)).otherwise(w)
    return F.array_join(F.zip_with(F.split(gap, BARE, -1), F.transform(F.regexp_extract_all(gap, F.lit(BARE), F.lit(0)), word),
                                   lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def moved_forms(docs: DataFrame, key: str) -> DataFrame:
    """(kind, form, attempt): forms whose surrogate collided and had to move; the result of the collision check."""
    found = docs.select(F.explode_outer(entities(F.col("text"))).alias("e")).where("e is not null").groupBy("e").agg(F.count("*").alias("n"))
    forms = found.select(F.explode_outer(units(F.col("e"))).alias("u")).select("u.kind", "u.form").distinct()
    now = stored(forms.withColumn("attempt", F.lit(0)), "pii_forms")
    while True:
        tried = now.withColumn("s", surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key))
        owner = tried.groupBy("kind", "s").agg(F.min("form").alias("owner"), F.count("*").alias("n"))
        shared = owner.where("n > 1").select("kind", "s", "owner")
        real = now.select("kind", F.col("form").alias("s"))
        written = tried.select("kind", "form", F.explode(spellings(F.col("kind"), F.col("s"))).alias("s"))
        lost = (tried.join(shared, ["kind", "s"]).where("form <> owner").select("kind", "form")
                .unionByName(written.join(real, ["kind", "s"], "left_semi").select("kind", "form")).distinct())
        lost = stored(lost, "pii_lost")
        if lost.isEmpty():
            return now.where("attempt > 0")
        bumped = now.join(lost.withColumn("again", F.lit(1)), ["kind", "form"], "left")
        now = stored(bumped.select("kind", "form", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "pii_forms")


def session_key(spark: SparkSession) -> str:
    """The session's key (``spark.sifter.pii.key``); if it has none, one is drawn and kept for the session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced; same columns, same rows."""
    if not key:
        raise ValueError("a key is required: without one anybody could rebuild the replacements")
    moved = stored(moved_forms(docs, key), "pii_moved")
    columns = docs.columns
    if moved.isEmpty():
        return docs.withColumn("text", _rewritten(F.col("text"), None, key)).select(*[F.col(f"`{c}`") for c in columns])
    ks = lambda t: [F.xxhash64(t).alias("k"), F.hash(t).alias("k2")]
    mentions = (docs.select(*ks(F.col("text")), F.explode_outer(entities(F.col("text"))).alias("e")).where("e is not null").distinct()
                .select("k", "k2", F.explode_outer(units(F.col("e"))).alias("u")).select("k", "k2", "u.kind", "u.form").distinct())
    size = moved.agg(F.sum(F.octet_length("form") + 64)).first()[0]
    maps = stored(mentions.join(F.broadcast(moved) if size <= BROADCAST_BYTES else moved, ["kind", "form"])
                  .groupBy("k", "k2").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(SEP, "kind", "form"), "attempt"))).alias("attempts")), "pii_maps")
    size = maps.agg(F.sum(F.octet_length(F.to_json("attempts")) * 2 + 64)).first()[0] or 0
    m = (F.broadcast(maps) if size <= BROADCAST_BYTES else maps).alias("m")
    d = docs.alias("d")
    joined = d.join(m, (F.xxhash64(F.col("d.text")) == F.col("m.k")) & (F.hash(F.col("d.text")) == F.col("m.k2")), "left")
    text = _rewritten(F.col("d.text"), F.coalesce(F.col("m.attempts"), F.create_map().cast("map<string,int>")), key).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"d.`{c}`") for c in columns])


def _rewritten(text: Column, attempts: Column | None, key: str) -> Column:
    """Pieces between entities and their replacements, in turn."""
    def put(ents: Column, known: Column) -> Column:
        gaps = F.split(text, ENTITY, -1)
        gaps = F.when(F.size(known) > 0, F.transform(gaps, lambda g: untitled(g, known, attempts, key))).otherwise(gaps)
        return F.array_join(F.zip_with(gaps, F.transform(ents, lambda e: replacement(e, known, attempts, key)),
                                       lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(HINT), _let(entities(text), lambda ents: _let(known_names(ents), lambda known: put(ents, known)))).otherwise(text)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many entities each had."""
    docs = table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", "text", F.size(entities(F.col("text"))).cast("long").alias("n_entities"))
    return pseudonymise(marked, session_key(spark))
