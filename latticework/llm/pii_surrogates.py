"""PII: detected entities receive keyed, type-consistent surrogates that keep apart what
differs and together what is the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import cut, free_name, written

KEY = "latticework"
#: What is detected, in order of precedence. Repeated groups are bounded, by the
#: standard's lengths in addresses, since the JVM matches them by recursion.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){0,125}\.\p{L}{2,63}"
SECRET = r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,48})(?![0-9A-Za-z])"
SECRET_STARTS = ("sk-", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
CARD = r"(?<![\d.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}(?:[ .-]?\d{2,4}){1,2}(?!\d)|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])"
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа", "Κυρία")
TITLE = rf"(?<!\p{{L}})(?:{'|'.join(MALE + FEMALE)})\.? "
NAME = r"\p{Lu}[\p{L}'’-]+"
PERSON = rf"{TITLE}{NAME}(?: {NAME})?(?!\p{{L}})"
KINDS = (("email", EMAIL), ("secret", SECRET), ("ip", IP), ("iban", IBAN), ("card", CARD), ("ssn", SSN), ("phone", PHONE), ("person", PERSON))
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
#: Alphabets of surrogates by script, and syllables of names.
ALPHABETS = (("Cyrillic", "абвгдежзиклмнопрстуфхцчшэюя"), ("Greek", "αβγδεζηθικλμνξοπρστυφχψω"), ("Han", "安白陈高何江李林刘马宋王吴杨张周"))
LATIN, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
SYLLABLES = {
    "Latin": "ba be bo da de do fa fe fi ga go ha he jo ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi".split(),
    "Cyrillic": "ба бе бо ва ве ви да де до за зе ка ко ла ле ли ма ме ми на не ни па пе ра ре ри са се со та те ти".split(),
    "Greek": "βα βε γα γε δα δε δι κα κο λα λε λι μα με μι να νε νι πα πε ρα ρε ρι σα σε τα τε τι".split(),
}
#: From this attempt on, forms may grow: the values of the entity's own form may have run out.
CROWDED = 10
ENDS = {"Latin": ("a", "n", "r"), "Cyrillic": ("а", "н", "р"), "Greek": ("α", "ς", "ς")}


def entities(text: Column) -> Column:
    """All entities in order. A text without a digit, `@`, title or start of a secret, told at
    little cost, has none."""
    maybe = F.contains(text, F.lit("@")) | text.rlike(r"\d") | reduce(lambda a, t: a | F.contains(text, F.lit(t)), MALE + FEMALE, F.lit(False))
    secret = text.rlike(r"[a-f]{32}") | reduce(lambda a, t: a | F.contains(text, F.lit(t)), SECRET_STARTS, F.lit(False))
    return F.when(maybe | secret, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def titled(titles: tuple[str, ...]) -> str:
    return rf"^(?:{'|'.join(titles)})\.? "


def digest(kind: Column, canonical: Column, attempt: int, key: str) -> Column:
    """128 hex digits, keyed."""
    part = lambda i: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical, F.lit(str(attempt)), F.lit(str(i))), 256)
    return F.concat(part(0), part(1))


def byte(at: Column, i: Column) -> Column:
    return F.conv(F.substring(at, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pick(alphabet: str, b: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(b, F.lit(len(alphabet))) + 1, F.lit(1))


def like(c: Column, b: Column) -> Column:
    """A sign of the kind and script of the lower-case c."""
    out = F.when(c.rlike(r"^\p{Nd}$"), pick(DIGITS, b))
    for script, alphabet in ALPHABETS:
        out = out.when(c.rlike(rf"^\p{{Is{script}}}$"), pick(alphabet, b))
    return out.otherwise(pick(LATIN, b))


def bare(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def luhn_sum(digits: Column) -> Column:
    n = F.length(digits)
    return F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0),
        lambda a, x: a + x,
    )


def mod_97(account: Column) -> Column:
    """Remainder of letters and digits read as a number, a letter as 10 to 35."""
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).when(c.rlike("^[A-Z]$"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a)
    return F.aggregate(F.split(F.upper(account), ""), F.lit(0), step)


def is_real(kind: Column, canonical: Column) -> Column:
    """Whether it is what it looks like: a card number has the right check digit."""
    return (kind != "card") | (luhn_sum(canonical) % 10 == 0)


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(word.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")


def name_like(kind: Column, word: Column, at: Column, attempt: int) -> Column:
    """A name of the word's script; its ending tells the gender of a given name."""

    def of(script: str) -> Column:
        words = SYLLABLES[script]
        parts = [F.element_at(F.array(*map(F.lit, words)), F.pmod(byte(at, F.lit(i)) * 7 + byte(at, F.lit(i + 32)), F.lit(len(words))) + 1) for i in range(3 + attempt)]
        female, male, family = ENDS[script]
        return F.concat(*parts, F.when(kind == "given_f", female).when(kind == "given_m", male).otherwise(family))

    s = script_of(word)
    return F.when(s == "Cyrillic", of("Cyrillic")).when(s == "Greek", of("Greek")).otherwise(of("Latin"))


def candidate(attempt: int, key: str) -> Column:
    """The surrogate's letters and digits, of columns kind, canonical and at (a digest). From
    attempt CROWDED on, octets have any length, and e-mail addresses and phone numbers a sign more, then
    two and so on."""
    more = max(0, 1 + (attempt - CROWDED) // 5)
    kind, canonical, at = F.col("kind"), F.col("canonical"), F.col("at")
    own = bare(canonical)
    each = lambda f: F.array_join(F.transform(F.split(own, ""), f), "")
    kept_end = F.length(own) - F.length(F.substring_index(canonical, ".", -1))  # an address keeps its last label
    email = each(lambda c, i: F.when(i >= kept_end, c).otherwise(like(c, byte(at, i))))
    secret = each(lambda c, i: F.when(c.rlike("^[0-9a-f]$") & own.rlike("^[0-9a-f]+$"), pick(HEX, byte(at, i))).otherwise(F.when((i < 4) & own.rlike("^(akia|gh[pousr]|sk)"), c).otherwise(like(c, byte(at, i)))))
    octet = lambda o, i: F.when(F.length(o) == 3, 100 + F.pmod(byte(at, i) * 3 + byte(at, i + 8), F.lit(156))).when(F.length(o) == 2, 10 + F.pmod(byte(at, i), F.lit(90))).otherwise(F.pmod(byte(at, i), F.lit(10))) if not more else byte(at, i)
    ip = F.array_join(F.transform(F.split(canonical, r"\."), lambda o, i: octet(o, i).cast("string")), ".")
    iban = each(lambda c, i: F.when(i < 2, c).otherwise(like(c, byte(at, i))))
    country, account, n = F.substring(own, 1, 2), F.substring(iban, F.lit(5), F.length(own)), F.length(own)
    check = F.lpad((98 - mod_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    valid = mod_97(F.concat(F.substring(own, F.lit(5), n), F.substring(own, 1, 4))) == 1
    iban = F.when(valid, F.concat(country, check, account)).otherwise(iban)
    digits = each(lambda c, i: pick(DIGITS, byte(at, i)))
    phone = F.when(canonical.startswith("+"), F.concat(F.substring(own, 1, 1), F.substring(digits, F.lit(2), F.length(own)))).otherwise(digits)
    first = F.substring(digits, F.lit(1), F.length(own) - 1)
    checked = F.concat(first, F.pmod(10 - luhn_sum(F.concat(first, F.lit("0"))), F.lit(10)).cast("string"))
    person = name_like(kind, canonical, at, min(attempt, 20))
    if more:
        email = F.concat(*[like(F.substring(own, 1, 1), byte(at, F.lit(63 - k))) for k in range(more)], email)
        phone = F.concat(phone, *[pick(DIGITS, byte(at, F.lit(63 - k))) for k in range(more)])
    return F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "card", checked).when(kind == "phone", phone).when(kind == "ssn", digits).otherwise(person)


def surrogates(entities: DataFrame, key: str = KEY, make=candidate, rounds: int = 100) -> DataFrame:
    """(kind, canonical, surrogate) for distinct (kind, canonical).

    A candidate is refused if it is a real value of its kind, or another entity's surrogate;
    of entities with equal candidates the first by name gets it. The refused try again with
    another digest until none is left, so different entities stay different."""
    real = entities.select("kind", F.when(F.col("kind") == "ip", F.col("canonical")).otherwise(bare(F.col("canonical"))).alias("surrogate")).distinct()
    pending, done = cut(entities.select("kind", "canonical").distinct()), None
    for attempt in range(rounds):
        tried = pending.withColumn("at", digest(F.col("kind"), F.col("canonical"), attempt, key)).withColumn("surrogate", make(attempt, key)).drop("at")
        free = tried.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "surrogate"], "left_anti")
        won = cut(free.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")).select("kind", "canonical", "surrogate"))
        pending = cut(pending.join(won, ["kind", "canonical"], "left_anti"))
        done = won if done is None else done.unionByName(won)
        if pending.isEmpty():
            return done
    raise RuntimeError(f"entities without a surrogate of their own after {rounds} rounds")


def parts_of(entity: Column) -> Column:
    """Parts that get a surrogate each: array of (lead, kind, surface)."""
    plain = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS[:-1]):
        plain = F.when(entity.rlike(rf"^(?:{pattern})$"), kind).otherwise(plain)
    title = F.regexp_extract(entity, rf"^({TITLE})", 1)
    names = F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " ")
    given = F.when(title.rlike(titled(MALE)), "given_m").when(title.rlike(titled(FEMALE)), "given_f").otherwise("given_u")
    person = F.transform(names, lambda w, i: F.struct(F.when(i == 0, title).otherwise(" ").alias("lead"), F.when(i == F.size(names) - 1, "family").otherwise(given).alias("kind"), w.alias("surface")))
    return F.when(plain.isNull(), person).otherwise(F.array(F.struct(F.lit("").alias("lead"), plain.alias("kind"), entity.alias("surface"))))


def canonical(kind: Column, surface: Column) -> Column:
    digits = F.regexp_replace(surface, r"[^0-9]", "")
    return F.when(kind.isin("card", "ssn"), digits).when(kind == "phone", F.concat(F.when(surface.startswith("+"), "+").otherwise(""), digits)).when(kind == "iban", bare(surface)).when(kind == "ip", surface).otherwise(F.lower(surface))


def rendered(kind: Column, surface: Column, surrogate: Column) -> Column:
    """The surrogate in the surface's format: its signs between letters and digits, its case.
    What an address or a number has more than the surface leads or ends it."""
    all_signs = F.regexp_replace(surrogate, r"[^\p{L}\p{N}]", "")
    extra = F.greatest(F.length(all_signs) - F.length(F.regexp_replace(surface, r"[^\p{L}\p{N}]", "")), F.lit(0))
    lead = F.when(kind == "email", F.substring(all_signs, F.lit(1), extra)).otherwise("")
    signs = F.substring(all_signs, F.length(lead) + 1, F.length(all_signs))
    end = F.when(kind == "phone", F.substring(signs, F.length(signs) - extra + 1, extra)).otherwise("")
    put = lambda c, x: F.when(c.rlike(r"^\p{Lu}$"), F.upper(x)).otherwise(x)
    filled = F.aggregate(
        F.split(surface, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda a, c: F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.struct(F.concat(a["out"], put(c, F.substring(signs, a["i"], F.lit(1)))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"))),
        lambda a: a["out"],
    )
    name = F.when(surface == F.upper(surface), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return F.when(kind.startswith("given") | (kind == "family"), name).when(kind == "ip", surrogate).otherwise(F.concat(lead, filled, end))


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with each entity in text_col replaced, and a column n_entities (int); see
    surrogate_documents(). If docs has a column of that name, underscores are added."""
    names = list(docs.columns)
    row, found, new, real = (free_name(names, x) for x in ("_row", "_found", "_new", "_real"))
    count = free_name(names, "n_entities")
    marked = written(docs.withColumn(found, entities(F.coalesce(F.col(text_col), F.lit("")))))
    plain = marked.where(F.size(found) == 0).select(*[F.col(f"`{c}`") for c in names], F.lit(0).alias(count))
    some = marked.where(F.size(found) > 0).withColumn(row, F.sha2(F.concat_ws("\x1f", F.col(id_col).cast("string"), F.col(text_col)), 256))
    parts = some.select(F.col(row).alias("row"), F.posexplode(found).alias("k", "entity")).select("row", "k", F.posexplode(parts_of(F.col("entity"))).alias("j", "part"))
    parts = cut(parts.select("row", "k", "j", "part.lead", "part.kind", "part.surface", canonical(F.col("part.kind"), F.col("part.surface")).alias("canonical")).distinct())
    of = surrogates(parts.where(is_real(F.col("kind"), F.col("canonical"))).select("kind", "canonical"), key)
    made = rendered(F.col("kind"), F.col("surface"), F.col("surrogate"))
    done = parts.join(of, ["kind", "canonical"], "left").select("row", "k", "j", F.col("surrogate").isNotNull().cast("int").alias("real"), F.concat("lead", F.coalesce(made, "surface")).alias("text"))
    whole = done.groupBy("row", "k").agg(F.max("real").alias("real"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "text"))), lambda x: x["text"]), "").alias("text"))
    listed = whole.groupBy("row").agg(F.sum("real").cast("int").alias(real), F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias(new)).withColumnRenamed("row", row)
    between = F.split(F.col(text_col), ANY, -1)
    joined = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(F.col(new), i), F.lit("")))), "")
    changed = some.join(listed, row).select(*[(joined if c == text_col else F.col(f"`{c}`")).alias(c) for c in names], F.col(real).alias(count))
    return plain.unionByName(changed)


def surrogate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """One row for each row of docs: (doc_id, text, n_entities).

    E-mail and IP addresses, phone, card, bank account and social security numbers, secrets
    and titled names in the whole text become surrogates that depend on the key and the
    entity: the same entity, in whatever format or case, has the same one everywhere, and two
    entities of a kind never share one, nor is it a real value of the table. A surrogate keeps
    the entity's format, script and case, and, but for names and for forms whose values run
    out (addresses and phone numbers then grow), its length; an address its last label, an international
    number its first digit, a card number and a valid bank account number their check digits'
    validity; numbers that look like a card's but fail its check digit are left alone; a given name the gender that the
    title tells, and a family name alone is the same person's as with a given name. Null text
    stays null, texts without entities stay as they are; repeated rows and null ids are
    returned as they are; an empty table gives an empty result; other columns are ignored.

    Texts of any length are searched; the local part of an address has up to 64 characters, its
    host up to 126 labels of up to 63, as the standards have it. Texts are searched once, and
    written with what was found. Only documents with entities are shuffled. A frequent entity is one row of the table of
    distinct entities; Spark can split its occurrences, which are narrow rows, in the join.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return replace_entities(rows, "doc_id", "text", key)
