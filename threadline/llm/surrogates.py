"""PII surrogates: detected entities become keyed stand-ins of their own type and format, the same one wherever they occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadline.durable import durable

# Kinds of entities and their patterns, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "password": r"(?<==)(?<=\b(?i:password)=)[^\s\"'&;,]+",
    "token": r"(?<=\")(?<=\b(?i:token) = \")[^\"\s]{8,}(?=\")",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}\b|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}\b|(?<![\w-])\d{3}-\d{3}-\d{4}\b",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{4}[ -]?){3}\d{4}(?![\w-])",
    "name": r"(?=[DFHMSг])(?<![\p{L}\p{N}_])(?:Mr|Ms|Dr|Sr|Mrs|Mme|Sra|Herr|Frau|Miss|г-н|г-жа)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
# A title with what follows it up to the name, and the titles that tell a gender.
TITLE = r"^(?:Mr|Ms|Dr|Sr|Mrs|Mme|Sra|Herr|Frau|Miss|г-н|г-жа)\.? (?=\p{Lu}\p{Ll})"
WOMEN, MEN = r"^(?:Ms|Mrs|Mme|Sra|Frau|Miss|г-жа)\.? ", r"^(?:Mr|Sr|Herr|г-н)\.? "
# Syllables of invented names, in each script.
SYLLABLES = {
    "Latin": "ba be bi bo da de di do fa fe fi fo ga ge go ha he ho ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se so ta te ti to va ve vi vo za ze zo".split(),
    "Cyrillic": "ба бе би бо да де ди до га ге го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе по ра ре ри ро са се со та те ти то ва ве ви во за зе зо".split(),
}
#: Syllables of an invented name at first: 53 to the power of 4 are 7.9 million names before any gets longer.
NAME_SYLLABLES = 4
#: Without a title that tells, given names that end like these are taken for women's; Cyrillic surnames tell by themselves.
FEMININE = "(?:a|e|ie|y|а|я)$"
#: Up to so many entities whose surrogate isn't their first choice are named in the plan; more are joined to the texts.
MOST_EXCEPTIONS = 1000
#: From this attempt on a format counts as exhausted: surrogates get three digits more with each attempt, names a syllable with every third.
LONGER_FROM = 8
ROUNDS = 8


def _any() -> str:
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _may_hold() -> Column:
    """Whether a text can hold any entity: all kinds but names have a digit, @, = or a key's first letters, names a title."""
    text = F.col("_text")
    quick = text.rlike("[0-9@=]") | F.contains(text, F.lit("AKIA")) | F.contains(text, F.lit("ASIA"))
    return F.coalesce(quick | text.rlike(PATTERNS["name"]), F.lit(False))


def _bare(match: Column) -> Column:
    """What a match stands for: a name without its title, and all else as it is."""
    return F.regexp_replace(match, TITLE, "")


def _gender(match: Column) -> Column:
    """f or m, by a name's title; n where it doesn't tell."""
    return F.when(match.rlike(WOMEN), F.lit("f")).when(match.rlike(MEN), F.lit("m")).otherwise(F.lit("n"))


def _parts(match: Column) -> Column:
    """The entities of a match, as structs of e and g: each word of a name by itself, and all else whole. g is a given name's gender,
    and s for surnames (the second of two words, or a single one) and whatever is no name."""
    given = F.when(F.contains(_bare(match), F.lit(" ")), _gender(match)).otherwise(F.lit("s"))
    words = F.transform(F.split(_bare(match), " "), lambda w, i: F.struct(w.alias("e"), F.when(i == 0, given).otherwise(F.lit("s")).alias("g")))
    return F.when(_bare(match) != match, words).otherwise(F.array(F.struct(match.alias("e"), F.lit("s").alias("g"))))


def kind_of(entity: Column) -> Column:
    """The kind of a detected entity, from its form. What follows password= or token = has no form of its own and is a secret."""
    out = F.lit("secret")
    for kind in reversed([k for k in PATTERNS if k not in ("password", "token", "name")]):
        out = F.when(entity.rlike("^(?:" + PATTERNS[kind] + ")$"), F.lit(kind)).otherwise(out)
    return F.when(entity.rlike(r"^\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?$"), F.lit("name")).otherwise(out)


def _hash(key: str, *parts: Column) -> Column:
    """60 bits of a SHA-256 of key and parts, which can't be foretold without the key."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _permuted(number: Column, high: Column, low: Column, tag: Column, key: str) -> Column:
    """A keyed permutation of 0 .. high * low - 1, as an alternating Feistel network: equal numbers stay equal, others differ."""
    step = lambda s, i: F.when(
        i % 2 == 0, F.struct(F.pmod(s["a"] + F.pmod(_hash(key, tag, i, s["b"]), high), high).alias("a"), s["b"].alias("b"))
    ).otherwise(F.struct(s["a"].alias("a"), F.pmod(s["b"] + F.pmod(_hash(key, tag, i, s["a"]), low), low).alias("b")))
    start = F.struct(F.floor(number / low).cast("long").alias("a"), F.pmod(number, low).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * low + s["b"])


def _digits(entity: Column, skip: Column, key: str, tag: str, attempt: Column) -> Column:
    """The entity with its digits after the first `skip` ones permuted, as one number of up to 15 digits; all else stays."""
    digits = F.regexp_replace(entity, r"\D", "")
    rest = F.substring(digits, skip + 1, F.length(digits))
    head, tail = F.substring(rest, F.lit(1), F.greatest(F.length(rest) - 15, F.lit(0))), F.substring(rest, F.greatest(F.length(rest) - 14, F.lit(1)), F.lit(15))
    n = F.length(tail)
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    halves = power(n - F.floor(n / 2)), power(F.floor(n / 2))
    # what the number is permuted by depends on all that stays as it is
    fixed = F.concat(F.lit(tag), F.substring(digits, F.lit(1), skip), F.lit("/"), head, F.lit("/"), n.cast("string"), F.lit("/"), attempt.cast("string"))
    new = F.concat(F.substring(digits, F.lit(1), skip), head, F.lpad(_permuted(F.coalesce(tail.try_cast("long"), F.lit(0)), *halves, fixed, key).cast("string"), 15, "0").substr(F.lit(16) - n, n))


    def fill(n: Column) -> Column:
        put = lambda s, c: F.when(
            c.rlike(r"^\d$"), F.struct(F.concat(s["out"], F.substring(n, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
        return F.aggregate(F.split(entity, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda s: s["out"])

    return _let(new, fill)


def _luhn(digits: Column) -> Column:
    """The check digit that goes behind these digits."""
    value = lambda c, i: F.when((F.length(digits) - i) % 2 == 1, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.split(digits, ""), lambda c, i: value(c, i).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _card(entity: Column, key: str, attempt: Column) -> Column:
    digits = F.regexp_replace(entity, r"\D", "")
    body, last = F.substring(digits, F.lit(1), F.length(digits) - 1), F.substring(digits, F.length(digits), F.lit(1))
    at = F.length(entity)
    valid = last == _luhn(body)
    front = _digits(F.substring(entity, F.lit(1), at - 1), F.lit(1), key, "card", attempt)
    return F.when(valid, _let(front, lambda f: F.concat(f, _luhn(F.regexp_replace(f, r"\D", ""))))).otherwise(_digits(entity, F.lit(1), key, "card?", attempt))


def _ip(entity: Column, key: str, attempt: Column) -> Column:
    o = F.transform(F.split(entity, r"\."), lambda x: x.cast("long"))
    number = ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]
    side = F.lit(65536).cast("long")
    n = _permuted(number, side, side, F.concat(F.lit("ip"), attempt.cast("string")), key)
    part = lambda n, k: F.shiftright(n, k).bitwiseAND(F.lit(255).cast("long")).cast("string")
    return _let(n, lambda n: F.concat_ws(".", part(n, 24), part(n, 16), part(n, 8), part(n, 0)))


def _letters(entity: Column, key: str, attempt: Column, salt: str) -> Column:
    """Letters become letters of their case and digits digits, by a hash of the whole entity and the place; all else stays."""
    start = F.sha2(F.concat(F.lit(f"{key}:{salt}:"), attempt.cast("string"), F.lit(":"), entity).cast("binary"), 256)

    def put(seed: Column) -> Column:
        pick = lambda i, n: F.pmod(_hash(key, seed, i), F.lit(n)).cast("int") + 1
        one = lambda c, i: (
            F.when(c.rlike("^[a-z]$"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), pick(i, 26), F.lit(1)))
            .when(c.rlike("^[A-Z]$"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), pick(i, 26), F.lit(1)))
            .when(c.rlike("^[0-9]$"), F.substring(F.lit("0123456789"), pick(i, 10), F.lit(1)))
            .otherwise(c)
        )
        return F.array_join(F.transform(F.split(entity, ""), one), "")

    return _let(start, put)


def _hex(entity: Column, key: str, attempt: Column) -> Column:
    """A string of hexadecimal digits of the entity's length."""
    more = lambda i: F.sha2(F.concat(F.lit(f"{key}:hex{i}:"), attempt.cast("string"), F.lit(":"), entity).cast("binary"), 256)
    return F.substring(F.concat(more(0), more(1)), F.lit(1), F.length(entity))


def _email(entity: Column, key: str, attempt: Column) -> Column:
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    seed = F.sha2(F.concat(F.lit(f"{key}:email:"), attempt.cast("string"), F.lit(":"), F.lower(entity)).cast("binary"), 256)
    # the first label of the reserved domain tells apart what short local parts can't
    return F.concat(_letters(F.concat(local), key + "|", F.concat(attempt.cast("string"), domain), "email"), F.lit("@mail"), F.substring(seed, 1, 10), F.lit(".example.org"))


def _name(word: Column, key: str, attempt: Column, role: Column) -> Column:
    """An invented name in the word's script. By its role it is a surname, or a given name whose ending tells its gender."""
    cyrillic, given = word.rlike(r"^\p{IsCyrillic}"), role != "s"
    woman = F.when(role.isin("f", "m"), role == "f").otherwise(word.rlike(FEMININE))
    seed = F.sha2(F.concat(F.lit(f"{key}:name:"), attempt.cast("string"), F.lit(":"), word).cast("binary"), 256)

    def made(script: str) -> Column:
        pool = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        part = lambda k: F.element_at(pool, F.pmod(_hash(key, seed, k), F.lit(len(SYLLABLES[script]))).cast("int") + 1)
        return F.array_join(F.transform(F.sequence(F.lit(1), (F.lit(NAME_SYLLABLES) + F.floor(attempt / 3)).cast("int")), part), "")

    latin = F.concat(made("Latin"), F.when(~given, F.lit("ler")).when(woman, F.lit("na")).otherwise(F.lit("ron")))
    other = F.concat(made("Cyrillic"), F.when(~given & woman, F.lit("ина")).when(~given, F.lit("ин")).when(woman, F.lit("на")).otherwise(F.lit("рон")))
    return F.initcap(F.when(cyrillic, other).otherwise(latin))


def _longer(entity: Column, key: str, attempt: Column) -> Column:
    """The digits that go behind a surrogate whose format is exhausted; empty at first."""
    more = F.translate(F.sha2(F.concat(F.lit(f"{key}:more:"), attempt.cast("string"), F.lit(":"), entity).cast("binary"), 256), "abcdef", "012345")
    return F.when(attempt < LONGER_FROM, F.lit("")).otherwise(F.substring(more, F.lit(1), (attempt - LONGER_FROM + 1) * 3))


def surrogate(entity: Column, key: str, attempt: Column, role: Column) -> Column:
    """The stand-in of an entity, names word by word: of its kind, its script, its role and, but for names, mail domains and exhausted formats, its length and punctuation."""

    def of(kind: Column) -> Column:
        code = F.when(entity.startswith("+"), F.length(F.regexp_extract(entity, r"^\+(\d{1,3})\b", 1))).otherwise(F.lit(0))
        made = (
            F.when(kind == "email", _email(entity, key, attempt))
            .when(kind == "ip", _ip(entity, key, attempt))
            .when(kind == "card", _card(entity, key, attempt))
            .when(kind == "phone", _let(code, lambda n: _digits(entity, n, key, "phone", attempt)))
            .when(kind == "ssn", _digits(entity, F.lit(0), key, "ssn", attempt))
            .when(kind == "access_key", F.concat(F.substring(entity, 1, 4), _letters(F.substring(entity, F.lit(5), F.length(entity)), key, attempt, "access")))
            .when(kind == "name", _name(entity, key, attempt, role))
            .when(entity.rlike("^[0-9a-f]+$"), _hex(entity, key, attempt))
            .when(entity.rlike("^[0-9A-F]+$"), F.upper(_hex(entity, key, attempt)))
            .otherwise(_letters(entity, key, attempt, "secret"))
        )
        return F.concat(made, F.when(kind.isin("name", "email"), F.lit("")).otherwise(_longer(entity, key, attempt)))

    return _let(kind_of(entity), of)


def _attempts(entities: DataFrame, key: str) -> DataFrame:
    """_e, _n and _g: entities that need another attempt than 0, so that no two entities share a surrogate and none gets a surrogate
    that occurs as an entity itself; and words of names that occur in several roles, with the one that is left: a given name's
    before a surname's, of the gender that its titles tell, and n if they tell both or none. entities: _e and _g, distinct. Who clashes goes on to its next attempt; as later ones are longer, the search ends even if all values of a
    format occur."""
    men, women = F.bool_or(F.col("_g") == "m"), F.bool_or(F.col("_g") == "f")
    settled = entities.groupBy("_e").agg(F.when(men & ~women, "m").when(women & ~men, "f").when(F.bool_and(F.col("_g") == "s"), "s").otherwise("n").alias("_g"), (F.count("*") > 1).alias("_differ"))
    made = durable(settled.select("_e", "_g", "_differ", F.lit(0).alias("_n"), surrogate(F.col("_e"), key, F.lit(0), F.col("_g")).alias("_s")))
    known = made.select(F.col("_e").alias("_s"))
    while True:
        shared = made.groupBy("_s").agg(F.count("*").alias("n"), F.min(F.struct("_n", "_e"))["_e"].alias("_first")).where("n > 1").select("_s", "_first")
        columns = ["_e", "_g", "_differ", "_n"]
        clash = made.join(shared, "_s").where("_e <> _first").select(columns).union(made.join(known, "_s").select(columns)).distinct()
        moved = clash.withColumn("_n", F.col("_n") + 1)
        moved = durable(moved.withColumn("_s", surrogate(F.col("_e"), key, F.col("_n"), F.col("_g"))))
        if moved.isEmpty():
            return made.where("_n > 0 or _differ").select("_e", "_n", "_g")
        made = durable(made.join(moved.select("_e"), "_e", "left_anti").unionByName(moved))


def _literal(exceptions: dict[str, tuple[int, str]]) -> Column:
    """A map from entities to struct(n, g)."""
    return F.create_map(*[x for e, (n, g) in sorted(exceptions.items()) for x in (F.lit(e), F.struct(F.lit(n).alias("n"), F.lit(g).alias("g")))])


def _with_attempts(rows: DataFrame, again: DataFrame) -> DataFrame:
    """rows with _attempts, a map from those of their entities in _found that are in again; null if none is."""
    rows = rows.withColumn("_set", F.array_distinct(F.transform(F.flatten(F.transform("_found", _parts)), lambda p: p["e"])))
    some = rows.where(F.size("_set") > 0)
    sets = some.select("_set").distinct().select("_set", F.explode("_set").alias("_e")).join(again, "_e")
    maps = sets.groupBy("_set").agg(F.map_from_entries(F.collect_list(F.struct("_e", F.struct(F.col("_n").alias("n"), F.col("_g").alias("g"))))).alias("_attempts"))
    without = rows.where(F.size("_set") == 0).withColumn("_attempts", F.lit(None).cast("map<string,struct<n:int,g:string>>"))
    return some.join(maps, "_set", "left").select(*without.columns).union(without)


def _again(gap: Column, names: Column) -> Column:
    """A text between entities, as struct(text, n): the words of the document's names in it, n of them, get their stand-ins.
    names: structs of word and new."""
    words = F.transform(names, lambda x: x["word"])
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    found = F.regexp_extract_all(gap, pattern, F.lit(0))
    new = F.transform(found, lambda w: F.element_at(names, F.array_position(words, w).cast("int"))["new"])
    put = F.array_join(F.flatten(F.zip_with(F.split(gap, pattern, -1), F.concat(new, F.array(F.lit(""))), lambda g, s: F.array(g, s))), "")
    return F.when(F.size(names) > 0, F.struct(put.alias("text"), F.size(found).alias("n"))).otherwise(F.struct(gap.alias("text"), F.lit(0).alias("n")))


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with their text rewritten, n_entities (occurrences) and kinds (the kinds found, sorted).

    Emails, access keys, passwords, tokens, IPv4 addresses, phone and card numbers, US social security numbers and names after
    a title are replaced; so are the words of such a name wherever they stand in the same document. Entities are whole matches, but
    for names their words: a word is one name wherever it occurs, so a full name and its surname agree. One entity has one
    surrogate in all documents, and no two entities share one: digits are permuted within their format by a keyed permutation,
    other surrogates are hashed with the key, and the surrogates of all distinct entities are checked against each other and
    against the entities themselves; who clashes tries again. Who has the key can undo the permutation, so there is no default
    one. A title decides the gender of a given name; where titles of one name differ, the one that tells does, and a word
    that is a given name anywhere has a given name's surrogate everywhere. Null stays null,
    and texts without entities stay as they are. Every row counts by itself; an empty table gives an empty result. Columns named
    n_entities or kinds are replaced, all others pass through.
    """
    if not key:
        raise ValueError("a secret key is needed")
    docs = docs.drop("n_entities", "kinds")
    none = F.array().cast("array<string>")
    found = F.when(_may_hold(), F.regexp_extract_all(F.col("_text"), F.lit(_any()), F.lit(0))).otherwise(none)
    matches = docs.select(F.col(text).alias("_text")).select(F.explode(F.array_distinct(found)).alias("_m"))
    parts = matches.select(F.explode(_parts(F.col("_m"))).alias("_p"))
    entities = durable(parts.select(F.col("_p.e").alias("_e"), F.col("_p.g").alias("_g")).distinct())
    entities = durable(entities.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, entities.rdd.getNumPartitions()), "_e"))
    again = durable(_attempts(entities, key))
    few = again.limit(MOST_EXCEPTIONS + 1).collect()
    rows = docs.select(F.struct("*").alias("_kept"), F.col(text).alias("_text")).withColumn("_found", found)
    tried = None
    if len(few) > MOST_EXCEPTIONS:
        rows, tried = _with_attempts(rows, again), F.col("_attempts")
    elif few:
        tried = _literal({r["_e"]: (r["_n"], r["_g"]) for r in few})

    def stand_in(p: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), p["g"].alias("g"))
        return _let(first if tried is None else F.coalesce(F.element_at(tried, p["e"]), first), lambda t: surrogate(p["e"], key, t["n"], t["g"]))

    def parsed(m: Column) -> Column:
        """struct(m, e, new): a match, its entity and the entity's stand-in."""
        return F.struct(m.alias("m"), _bare(m).alias("e"), F.array_join(F.transform(_parts(m), stand_in), " ").alias("new"))

    rows = rows.withColumn("_parsed", F.transform("_found", parsed))
    pairs = lambda x: F.zip_with(F.split(x["e"], " "), F.split(x["new"], " "), lambda w, n: F.struct(w.alias("word"), n.alias("new")))
    named = F.flatten(F.transform(F.filter("_parsed", lambda x: x["m"] != x["e"]), pairs))
    rows = rows.withColumn("_names", F.filter(named, lambda x: F.length(x["word"]) >= 3))
    rows = rows.withColumn("_gaps", F.when(F.size("_found") > 0, F.transform(F.split(F.col("_text"), _any(), -1), lambda g: _again(g, F.col("_names")))))
    new = F.transform("_parsed", lambda x: F.concat(F.substring(x["m"], F.lit(1), F.length(x["m"]) - F.length(x["e"])), x["new"]))
    whole = F.array_join(F.flatten(F.zip_with("_gaps", F.concat(new, F.array(F.lit(""))), lambda g, s: F.array(g["text"], s))), "")
    count = F.size("_found") + F.aggregate("_gaps", F.lit(0), lambda n, g: n + g["n"])
    rows = rows.withColumn("_new", F.when(F.size("_found") > 0, whole).otherwise(F.col("_text")))
    kinds = F.array_sort(F.array_distinct(F.transform("_parsed", lambda x: kind_of(x["e"]))))
    kept = [F.col("_new").alias(c) if c == text else F.col(f"_kept.`{c}`") for c in docs.columns]
    return rows.select(*kept, F.when(F.size("_found") > 0, count).otherwise(0).cast("long").alias("n_entities"), kinds.alias("kinds"))
