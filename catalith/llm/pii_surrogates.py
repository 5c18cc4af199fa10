"""Surrogates for personal data, in built-in expressions only.

Entities (e-mail addresses, IPv4 addresses, phone and account numbers, and the
given and family names after a title) are replaced by keyed surrogates of the
same type and format: digits for digits, letters of the same case and script for
letters, given names of the title's gender.  An entity is known by its canonical
form (case, spaces and punctuation of numbers, and the +1 of a number of ten
digits aside), so that its mentions get the same surrogate in whatever format
each is written: coreference is kept.  Given and family names are entities of
their own, so that ``Mr. Smith`` and ``Mr. John Smith`` keep their common name.

Surrogates are checked over the whole corpus: none may equal an entity or
another's surrogate.  Losers of a collision try again with the next attempt,
until none is left.  Each attempt gives names a syllable more, so that the forms
grow faster than the names; where a format has too few values, e-mail addresses
get a letter more and numbers a digit more with each attempt from ATTEMPTS on.
Distinct entities therefore stay distinct.  Only IPv4 addresses cannot grow: of
four billion forms, one that is free is looked for MOST times, and a corpus
that leaves none is an error.

The texts are matched once: a pass marks the entities and stores texts with
entities in pieces, and all later steps read the pieces.  Only distinct entities
and the entities of texts are shuffled.  Mentions are made per distinct text, so
that a group of copies is one text, and joined with the surrogates by an ordinary
join, which Spark splits where an entity is hot.

Defined results: a null text stays null, an empty one empty; repeated rows each
get their own result; an empty table gives an empty table; other columns pass
through whatever their names, and a column already named like the output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Titles with the gender that they tell (fixed values).
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Пан", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Пані", "Κυρία"),
}
#: Syllables, endings and letters that surrogates are made of, by script and gender (fixed values).
SYLLABLES = {
    "latin": ("ba", "de", "fi", "ga", "ko", "la", "mi", "no", "pe", "ra", "so", "ta", "ve", "wi", "ju", "lo"),
    "cyrillic": ("ба", "ве", "ги", "да", "ко", "ла", "ми", "но", "пе", "ра", "со", "та", "фе", "ли", "жу", "ло"),
    "greek": ("βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "να", "ξε", "πι", "ρο", "σα", "τε", "φι", "χο"),
}
ENDINGS = {
    ("latin", "m"): ("n", "r", "s", "k"), ("latin", "f"): ("na", "ra", "sa", "ka"), ("cyrillic", "m"): ("н", "р", "с", "к"), ("cyrillic", "f"): ("на", "ра", "са", "ка"),
    ("greek", "m"): ("νος", "ρος", "κος", "λος"), ("greek", "f"): ("να", "ρα", "κα", "λα"),
}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: Attempts at a length, and in all.
ATTEMPTS, MOST = 4, 64

#: Letters beyond ASCII: Latin, Greek and Cyrillic.
_BEYOND = r"À-ɏͰ-ϿЀ-ӿ"
_EMAIL = rf"(?<![\w{_BEYOND}.%+-])[\w{_BEYOND}.%+-]++@[A-Za-z0-9{_BEYOND}-]+(?:\.[A-Za-z0-9{_BEYOND}-]+)*\.[A-Za-z{_BEYOND}]{{2,}}"
_IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
_PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
_ACCOUNT = r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?)(?![\w-])"
_PART = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+|-\p{Lu}\p{Ll}+)*"
_NAME = rf"(?<!\p{{L}})(?:{'|'.join(t for g in TITLES.values() for t in g)})\.? {_PART}(?: {_PART})?"
#: Nothing begins within a word of ASCII, and that is told first.
PATTERN = rf"(?<!\w)(?=[\w.%+(\-{_BEYOND}])(?:{_EMAIL}|{_IP}|{_PHONE}|{_ACCOUNT}|{_NAME})"
_TITLE = rf"^({'|'.join(t for g in TITLES.values() for t in g)})\.? "


def type_of(value: Column) -> Column:
    """email, ip, phone, account or name."""
    return (
        F.when(value.contains("@"), "email").when(value.rlike(rf"^(?:{_IP})$"), "ip").when(value.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]"), "phone")
        .when(value.rlike(r"^[A-Z]{2}\d{2}|^\d"), "account").otherwise("name")
    )


def _parts(before: Column, value: Column) -> Column:
    """The entities of a match, with the text before each: a name is its given and family names, of kinds like ``given:latin:f`` and ``family:latin``."""
    kind, title = type_of(value), F.regexp_extract(value, _TITLE, 0)
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.when(F.regexp_extract(value, _TITLE, 1).isin(*TITLES["f"]), "f").otherwise("m")
    words = F.split(F.substring(value, F.length(title) + 1, F.length(value)), " ")
    part = lambda b, v, k: F.struct(b.alias("before"), v.alias("value"), k.alias("kind"))
    of_name = F.transform(words, lambda w, k: part(F.when(k == 0, F.concat(before, title)).otherwise(" "), w, F.when(k < F.size(words) - 1, F.concat_ws(":", F.lit("given"), script(w), gender)).otherwise(F.concat(F.lit("family:"), script(w)))))
    return F.when(kind == "name", of_name).otherwise(F.array(part(before, value, kind)))


def entities_in(pieces: Column) -> Column:
    """The entities of a text in pieces (outside and inside of matches in turn), in order, with the text before each."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(pieces) / 2).cast("int") - 1), lambda i: _parts(F.get(pieces, 2 * i), F.get(pieces, 2 * i + 1))))


def _plain(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))


def canonical(kind: Column, value: Column) -> Column:
    """What two mentions of one entity have in common."""
    plain = _plain(value)
    national = (kind == "phone") & value.startswith("+1") & (F.length(plain) == 11)
    return F.when(national, F.substring(plain, 2, 10)).when(kind.isin("phone", "account"), plain).otherwise(F.lower(value))


def _number(h: Column, i: Column) -> Column:
    """The i-th number, 0 to 65535, of a hexadecimal hash of 128 digits."""
    return F.conv(F.substring(h, F.lit(1) + 4 * F.pmod(i, F.lit(32)), F.lit(4)), 16, 10).cast("int")


def candidate(kind: Column, canon: Column, key: str, attempt: int) -> Column:
    """The keyed surrogate of a canonical form, itself canonical."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(str(attempt))), 512)
    pick = lambda text, n: F.substring(F.lit(text), 1 + F.pmod(n, F.lit(len(text))), F.lit(1))
    at_sign, last_dot = F.instr(canon, "@"), F.length(F.substring_index(canon, ".", -1))
    # Kept: the first digit of a number, and an address's punctuation and top-level name.
    fixed = lambda i: ((kind == "phone") | (kind == "account")) & (i == 0) | (kind == "email") & (i >= F.length(canon) - last_dot) & (at_sign > 0)

    def char(c: Column, i: Column) -> Column:
        out = F.when(fixed(i), c).when(c.rlike(r"\d"), pick("0123456789", _number(h, i)))
        for script, name in (("cyrillic", "IsCyrillic"), ("greek", "IsGreek"), ("latin", "L")):
            out = out.when(c.rlike(rf"\p{{{name}}}"), pick(LETTERS[script], _number(h, i)))
        return out.otherwise(c)

    spelled = F.array_join(F.transform(F.split(canon, ""), char), "")
    if attempt >= ATTEMPTS:
        more = lambda pool: F.concat(*(pick(pool, _number(h, F.lit(31 - k % 32))) for k in range(attempt - ATTEMPTS + 1)))
        spelled = F.when(kind == "email", F.concat(more(LETTERS["latin"]), spelled)).otherwise(F.concat(spelled, more("0123456789")))
    octet = lambda k: (F.pmod(_number(h, F.lit(k)), F.lit(254)) + 1).cast("string")
    out = F.when(kind == "ip", F.concat_ws(".", *(octet(k) for k in range(4))))

    def name(script: str, gender: str) -> Column:
        of = lambda pool, n: F.element_at(F.array(*map(F.lit, pool)), 1 + F.pmod(n, F.lit(len(pool))))
        word = lambda i: F.concat(*(of(SYLLABLES[script], _number(h, (5 + attempt) * i + k)) for k in range(3 + attempt)), of(ENDINGS[script, gender], _number(h, (5 + attempt) * i + 3 + attempt)))
        return F.array_join(F.transform(F.split(canon, "-"), lambda _, i: word(i)), "-")

    for script, gender in ENDINGS:
        if script in SYLLABLES:
            out = out.when(kind == f"given:{script}:{gender}", name(script, gender))
            if gender == "m":  # family names do not tell the gender
                out = out.when(kind == f"family:{script}", name(script, "m"))
    return out.otherwise(spelled)


def written(kind: Column, value: Column, canon: Column, surrogate: Column) -> Column:
    """A surrogate in the format of a mention."""
    cased = lambda c, s: F.when((c != F.lower(c)) & (c == F.upper(c)), F.upper(s)).otherwise(s)
    chars, plain = F.split(value, ""), _plain(value)
    # What the canonical form leaves out is kept; what a longer surrogate has more goes behind.
    full = F.concat(F.substring(plain, F.lit(1), F.length(plain) - F.length(canon)), surrogate)
    ordinal = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
    number = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), cased(c, F.substring(full, ordinal(i), F.lit(1)))).otherwise(c)), "")
    number = F.concat(number, F.substring(full, F.length(plain) + 1, F.length(full)))
    mail = F.array_join(F.transform(F.split(surrogate, ""), lambda s, i: cased(F.coalesce(F.get(chars, F.greatest(i - F.length(surrogate) + F.length(value), F.lit(0))), s), s)), "")
    name = F.array_join(F.transform(F.split(surrogate, "-"), lambda x: F.initcap(x)), "-")
    return F.when(kind.isin("phone", "account"), number).when(kind == "email", mail).when(kind == "ip", surrogate).otherwise(name)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canon, surrogate`` for distinct ``kind, canon``: distinct ones, none of them an entity."""
    left, done = entities, None
    taken = entities.select("kind", F.col("canon").alias("form"), F.lit(1).alias("taken"), F.lit(None).cast("string").alias("canon"))
    for attempt in range(MOST):
        tried = left.select("kind", candidate(F.col("kind"), F.col("canon"), key, attempt).alias("form"), F.lit(0).alias("taken"), "canon")
        met = tried.union(taken).groupBy("kind", "form").agg(F.max("taken").alias("taken"), F.min("canon").alias("canon"))
        won = stored(met.where("taken = 0").select("kind", "canon", F.col("form").alias("surrogate")), "surrogates")
        done = won if done is None else done.union(won)
        left = stored(left.join(won, ["kind", "canon"], "left_anti"), "left")
        if left.isEmpty():
            return done
        taken = taken.union(won.select("kind", F.col("surrogate").alias("form"), F.lit(1).alias("taken"), F.lit(None).cast("string").alias("canon")))
    raise RuntimeError(f"no free surrogate after {MOST} attempts")


def replace(docs: DataFrame, key: str, text: str = "text", out: str = "entities") -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``out``: how many there were, by kind."""
    names = [c for c in docs.columns if c != out]
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    # Other columns travel in a struct, so that no name of theirs can clash.
    rest = F.struct(*(column(c).alias(f"c{k}") for k, c in enumerate(names) if c != text), F.lit(0).alias("none"))
    mark = F.concat(F.lit("\x01"), F.substring("h", 1, 32), F.lit("\x02"))  # of a text's own hash, so that no text has it
    marked = docs.select(rest.alias("rest"), column(text).alias("t")).withColumn("h", F.sha2(F.col("t"), 256))
    marked = marked.withColumn("m", F.regexp_replace("t", F.lit(PATTERN), F.concat(mark, F.lit("$0"), mark))).withColumn("m", F.split("m", mark))
    marked = stored(marked.withColumn("m", F.when(F.size("m") > 1, F.col("m"))).select("rest", "h", F.when(F.col("m").isNull(), F.col("t")).alias("t"), "m"), "marked")
    found = marked.where("m is not null").select("rest", "h", entities_in(F.col("m")).alias("parts"), F.element_at("m", -1).alias("tail"))
    texts = found.select("h", F.transform("parts", lambda p: F.struct(p["value"].alias("value"), p["kind"].alias("kind"))).alias("parts")).groupBy("h").agg(F.first("parts").alias("parts"))
    each = texts.select("h", F.posexplode("parts").alias("pos", "part")).select("h", "pos", "part.*").withColumn("canon", canonical(F.col("kind"), F.col("value")))
    each = stored(each, "mentions")
    known = surrogates(stored(each.select("kind", "canon").distinct(), "entities"), key)
    new = each.join(known, ["kind", "canon"]).select("h", "pos", "kind", written(F.col("kind"), F.col("value"), F.col("canon"), F.col("surrogate")).alias("new"))
    # A name counts once, by its family name.
    counted = F.when(F.col("kind").startswith("family"), "name").when(~F.col("kind").startswith("given"), F.col("kind"))
    by_text = new.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("pos", "new", counted.alias("kind")))).alias("new"))
    joined = found.join(by_text, "h")
    woven = F.concat(F.array_join(F.transform("parts", lambda p, i: F.concat(p["before"], F.get("new", i)["new"])), ""), "tail")
    kinds = F.array_distinct(F.filter(F.transform("new", lambda x: x["kind"]), lambda k: k.isNotNull()))
    counts = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter("new", lambda x: x["kind"] == k)).cast("long")))
    changed = joined.select("rest", woven.alias("t"), counts.alias("n"))
    same = marked.where("m is null").select("rest", "t", F.create_map().cast("map<string,long>").alias("n"))
    every = same.unionByName(changed)
    return every.select(*(F.col("t").alias(c) if c == text else F.col(f"rest.c{k}").alias(c) for k, c in enumerate(names)), F.col("n").alias(out))
