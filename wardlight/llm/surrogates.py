"""Personal data replaced by surrogates of the same type, gender, script and format; DataFrame functions only.

1. Entities are found with one pattern: e-mail addresses, IPv4 addresses, bank cards,
   IBANs, social security and phone numbers, and names after a title.
2. Each distinct entity, in a form that ignores spacing and letter case, is an atom; first and last names
   are atoms of their own, so "Mr. Jan Berg" and "Mr. Berg" stay the same person.
3. An atom's surrogate comes from a hash of a secret key, its kind and its form. Surrogates that meet
   another atom's surrogate or any original are drawn again until all are distinct.
4. Texts are put together again from the parts between entities and the surrogates.

Only atoms and the texts that hold entities are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.common import fresh, written

# Titles with the gender they tell, and syllables that names are made of.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Госпожа"],
    "n": ["Dr", "Prof"],
}
SYLLABLES = {
    "latin": ["ba", "den", "ga", "lo", "mar", "ni", "ro", "sel", "ta", "vi", "jor", "ke", "lan", "pe", "ri", "son"],
    "cyrillic": ["ба", "ден", "га", "ло", "мар", "ни", "ро", "сел", "та", "ви", "жор", "ке", "лан", "пе", "ри", "сон"],
}
ENDINGS = {
    "latin": {"m": ["o", "us", "an", "er"], "f": ["a", "ina", "elle", "ia"], "n": ["is", "en", "ey", "il"], "last": ["berg", "mann", "sen", "ton"]},
    "cyrillic": {"m": ["ан", "ор", "ей", "ил"], "f": ["а", "ина", "ия", "ея"], "n": ["и", "е", "о", "у"], "last": ["ко", "юк", "ых", "дзе"]},
}

BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ANY_TITLE = f"(?:{'|'.join(t for ts in TITLES.values() for t in ts)})(?![\\p{{L}}\\p{{N}}])\\.?"
#: A capitalised word that is no title, without a possessive ending, or an initial with its dot.
NAME = f"(?!{ANY_TITLE})(?:\\p{{Lu}}\\.(?= \\p{{L}})|\\p{{Lu}}(?:\\p{{L}}|['’-](?![sS](?!\\p{{L}}))(?=\\p{{L}}))*+)"
PARTICLE = "(?:von|vom|van|zu|zum|zur|und|der|den|dem|de|del|della|di|da|dos|das|du|des|la|le|ter|ten|af|av|y|e|bin|ibn|al|el)(?!\\p{L})"
PATTERNS = {
    "email": "(?<![\\p{L}\\p{N}._+-])[\\p{L}\\p{N}._+-]++@[\\p{L}\\p{N}-]++\\.[\\p{L}\\p{N}.-]*[\\p{L}\\p{N}]",
    "ip": f"(?<![0-9.]){BYTE}\\.{BYTE}\\.{BYTE}\\.{BYTE}(?![0-9]|\\.[0-9])",
    "iban": "(?<![\\p{L}\\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\\p{L}\\p{N}])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": "(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\\2[0-9]{5}|[0-9]{13,19})(?![0-9])",
    "phone": "(?<![\\p{L}\\p{N}+])\\+[0-9]{1,3}(?:[ .-]?\\(?[0-9]{1,4}\\)?){2,5}(?![0-9]|[.-][0-9])|(?<![\\p{N}])\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "person": f"(?<![\\p{{L}}\\p{{N}}]){ANY_TITLE}(?: {ANY_TITLE})*+(?: {PARTICLE})*+ {NAME}(?:(?: {PARTICLE})* {NAME})*",
}
# Groups are numbered anew in the joint pattern: the card's separators are its first two.
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity holds, found much faster: a digit, an at sign or a title.
HINT = f"[0-9@]|{'|'.join(t for ts in TITLES.values() for t in ts)}"
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя"}


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern fits the entity (the joint pattern tries them in the same order)."""
    column = F.lit("person")
    for kind in reversed([k for k in PATTERNS if k != "person"]):
        column = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(column)
    return column


def script_of(text: Column) -> Column:
    return F.when(text.rlike("\\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def is_name(word: Column) -> Column:
    """Whether a word of a person is a name: neither a title nor a particle."""
    return ~word.rlike(f"^(?:{ANY_TITLE}|{PARTICLE})$")


def atoms_of(entity: Column, kind: Column) -> Column:
    """Atoms ``(kind, form)`` of an entity: one, or the names of a person."""
    plain = F.when(kind == "email", F.lower(entity)).when(kind == "ip", entity).otherwise(
        F.upper(F.regexp_replace(entity, "[^\\p{L}\\p{N}]", ""))
    )
    title = F.regexp_extract(entity, "^(\\p{L}+)", 1)
    gender = F.when(title.isin(TITLES["m"]), F.lit("m")).when(title.isin(TITLES["f"]), F.lit("f")).otherwise(F.lit("n"))
    names = F.filter(F.split(entity, " "), is_name)
    first = F.concat(F.lit("first_"), gender)
    part = lambda name, i: F.struct(F.when(i < F.size(names) - 1, first).otherwise(F.lit("last")).alias("kind"), F.lower(name).alias("form"))
    person = F.transform(names, part)
    return F.when(kind == "person", person).otherwise(F.array(F.struct(kind.alias("kind"), plain.alias("form"))))


def pick(seed: Column, place: Column | int, count: int) -> Column:
    """A number from 0 to ``count - 1``, drawn by the seed and a place."""
    place = F.lit(place) if isinstance(place, int) else place
    return F.pmod(F.xxhash64(seed, place), F.lit(count)).cast("int")


def choose(seed: Column, place: int, options: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), pick(seed, place, len(options)) + 1)


def same_shape(form: Column, seed: Column, keep: Column | int = 0) -> Column:
    """Each letter becomes a letter of its script, each digit a digit; the first ``keep`` characters stay."""

    def one(c: Column, i: Column) -> Column:
        letter = lambda s: F.substring(F.lit(ALPHABETS[s]), pick(seed, i, len(ALPHABETS[s])) + 1, F.lit(1))
        upper = lambda made: F.when(c == F.lower(c), made).otherwise(F.upper(made))
        return (
            F.when(i < keep, c)
            .when(c.rlike("^\\p{N}$"), pick(seed, i, 10).cast("string"))
            .when(c.rlike("^\\p{IsCyrillic}$"), upper(letter("cyrillic")))
            .when(c.rlike("^\\p{L}$"), upper(letter("latin")))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(form, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Weighted digit sum of a card number; 0 modulo 10 for a valid one."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    weigh = lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), weigh), F.lit(0), lambda a, x: a + x)


def card_like(form: Column, seed: Column) -> Column:
    """Same length and first digit; a valid check digit if the original has one."""
    body = F.substring(same_shape(form, seed, 1), F.lit(1), F.length(form) - 1)
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return F.when(luhn_sum(form) % 10 == 0, F.concat(body, check)).otherwise(same_shape(form, seed, 1))


def iban_like(form: Column, seed: Column) -> Column:
    """Same country and length with valid check digits."""
    body = F.substring(same_shape(form, seed, 4), F.lit(5), F.length(form))
    turned = F.concat(body, F.substring(form, 1, 2), F.lit("00"))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (F.when(c.rlike("[0-9]"), a * 10).otherwise(a * 100) + value(c)) % 97
    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return F.concat(F.substring(form, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), body)


def ip_like(form: Column, seed: Column) -> Column:
    """Private addresses stay private, others public."""
    byte = lambda place, low, count: (pick(seed, place, count) + low).cast("string")
    public = F.concat_ws(".", byte(0, 11, 80), byte(1, 0, 256), byte(2, 0, 256), byte(3, 1, 254))
    private = F.concat_ws(".", F.lit("10"), byte(1, 0, 256), byte(2, 0, 256), byte(3, 1, 254))
    return F.when(form.rlike("^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)"), private).otherwise(public)


def email_like(form: Column, key: str, seed: Column, attempt: int) -> Column:
    """Local part and domain change on their own, so one domain stays one domain; the last label is kept."""
    local, domain = F.split_part(form, F.lit("@"), F.lit(1)), F.split_part(form, F.lit("@"), F.lit(2))
    place = F.length(domain) - F.length(F.split_part(domain, F.lit("."), F.lit(-1)))
    domain_seed = F.sha2(F.concat(F.lit(f"{key}|domain|"), domain), 256)
    other = F.concat(same_shape(F.substring(domain, F.lit(1), place), domain_seed), F.substring(domain, place + 1, F.length(domain)))
    # Later draws are longer: short local parts would run out.
    more = F.lpad(pick(seed, -1, 10 ** min(attempt, 9)).cast("string"), attempt, "0") if attempt else F.lit("")
    return F.concat(same_shape(local, seed), more, F.lit("@"), other)


def name_like(form: Column, kind: Column, seed: Column, attempt: int) -> Column:
    """A made-up name of the form's script, with an ending for the gender."""
    made = None
    for script, syllables in SYLLABLES.items():
        stem = F.concat(*[choose(seed, i, syllables) for i in range(2 + attempt)])
        ending = F.lit("")
        for group, options in ENDINGS[script].items():
            ending = F.when(kind == (group if group == "last" else f"first_{group}"), choose(seed, 99, options)).otherwise(ending)
        name = F.concat(stem, ending)
        made = name if made is None else F.when(script_of(form) == script, name).otherwise(made)
    return made


def surrogate_of(key: str, attempt: int) -> Column:
    """Surrogate form of the atom in columns ``kind`` and ``form``."""
    kind, form = F.col("kind"), F.col("form")
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, F.lit(str(attempt)), form), 256)
    return (
        F.when(kind == "email", email_like(form, key, seed, attempt))
        .when(kind == "ip", ip_like(form, seed))
        .when(kind == "card", card_like(form, seed))
        .when(kind == "iban", iban_like(form, seed))
        .when(kind == "phone", same_shape(form, seed, 2))
        .when(kind == "ssn", same_shape(form, seed))
        .otherwise(name_like(form, kind, seed, attempt))
    )


def assigned_surrogates(atoms: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """``(kind, form, surrogate)``: distinct within a kind and never an original of that kind."""
    done, pending = None, atoms
    for attempt in range(rounds):
        drawn = pending.withColumn("surrogate", surrogate_of(key, attempt))
        originals = atoms.select("kind", F.col("form").alias("surrogate"))
        free = drawn.join(originals, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        # Of atoms that drew the same surrogate the smallest keeps it.
        winner = free.groupBy("kind", "surrogate").agg(F.min("form").alias("form")).select("kind", "form", "surrogate")
        taken = written(winner, "surrogates")
        done = taken if done is None else done.unionByName(taken)
        pending = written(pending.join(taken, ["kind", "form"], "left_anti"), "pending")
        if pending.isEmpty():
            return done
    raise ValueError(f"no distinct surrogates after {rounds} draws; some kind has too many entities")


def in_format(entity: Column, surrogates: Column) -> Column:
    """Surrogate forms put into the entity's spacing, title and letter case."""
    one = F.element_at(surrogates, 1)
    kind = kind_of(entity)
    chars = F.split(entity, "")
    spaced = F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                c.rlike("^[\\p{L}\\p{N}]$"),
                F.substring(one, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^\\p{L}\\p{N}]", "")), F.lit(1)),
            ).otherwise(c),
        ),
        "",
    )
    upper = (entity == F.upper(entity)) & (entity != F.lower(entity))
    made = F.transform(surrogates, lambda s: F.when(upper, F.upper(s)).otherwise(F.initcap(s)))
    words = F.split(entity, " ")
    before = lambda i: F.size(F.filter(F.slice(words, 1, i), is_name))
    person = F.array_join(F.transform(words, lambda w, i: F.when(is_name(w), F.get(made, before(i))).otherwise(w)), " ")
    return (
        F.when(kind == "person", person)
        .when(kind == "email", F.when(upper, F.upper(one)).otherwise(one))
        .when(kind == "ip", one)
        .otherwise(spaced)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with entities in ``text_col`` replaced, and the number of entities in ``count_col``.

    Equal entities get equal surrogates in all documents. Null texts stay null with no entities; texts
    without entities are unchanged. Repeated rows each keep a row; an empty table gives an
    empty table. Other columns are kept, but a column named ``count_col`` is replaced.
    """
    if not key:
        raise ValueError("a key is needed")
    base = docs.drop(*[c for c in docs.columns if c.lower() == count_col.lower()])
    has = F.coalesce(F.col(text_col).rlike(HINT) & F.col(text_col).rlike(ENTITY), F.lit(False))
    name = fresh(base, "entity_key")
    touched = base.filter(has).withColumn(name, F.sha2(F.col(text_col), 256))
    # Copies of a text are worked on once.
    found = touched.select(F.col(name).alias("text_key"), F.regexp_extract_all(F.col(text_col), F.lit(ENTITY), 0).alias("entities"))
    found = written(found.dropDuplicates(["text_key"]), "entities")
    entities = found.select(F.explode("entities").alias("entity")).distinct()
    parts = entities.select("entity", F.posexplode(atoms_of(F.col("entity"), kind_of(F.col("entity")))).alias("place", "atom"))
    parts = written(parts.select("entity", "place", "atom.*"), "atoms")
    surrogates = assigned_surrogates(parts.select("kind", "form").distinct(), key)
    replaced = parts.join(surrogates, ["kind", "form"]).groupBy("entity").agg(
        F.sort_array(F.collect_list(F.struct("place", "surrogate"))).alias("found")
    )
    replaced = replaced.select("entity", in_format(F.col("entity"), F.col("found.surrogate")).alias("made"))
    # A text's surrogates are gathered in pieces of its own entity list, so their number is the text's own.
    rows = found.select("text_key", F.posexplode("entities").alias("place", "entity")).join(replaced, "entity")
    by_text = rows.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("place", "made"))).alias("made"))
    by_text = by_text.select(F.col("text_key").alias(name), F.col("made.made").alias(fresh(base, "made_list")))
    made_list = by_text.columns[1]
    between = F.split(F.col(text_col), ENTITY, -1)
    woven = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get(F.col(made_list), i), F.lit("")))), "")
    changed = touched.join(by_text, name).withColumns({text_col: woven, count_col: F.size(made_list).cast("long")})
    unchanged = base.filter(~has).withColumn(count_col, F.lit(0).cast("long"))
    return changed.drop(name, made_list).unionByName(unchanged)
