"""PII surrogates: every detected entity gets a keyed, type-consistent
replacement. DataFrame functions only.

* Detection: one regular expression for all types; a type follows from the form
  of the match. Names are found after a form of address; their words are then
  entities wherever they stand in the text as whole words (a trailing 's is no part
  of a name). Texts without a digit, one of @=:, a key's prefix or a form of address
  are not searched.
* Surrogates keep the form: letters stay letters of the same case and script,
  digits stay digits, separators stay. Addresses keep their top-level domain, IP
  addresses stay valid, card numbers keep their first digit and pass the check
  digit test if the original does, phone numbers keep their country code, keys
  keep their public prefix, hexadecimal secrets stay hexadecimal. Given names get one
  of the same gender and script, surnames one of the same script; names in capitals
  stay in capitals.
* Coreference: a surrogate depends on the type and the entity's core (its letters
  and digits, lower case), so one entity gets the same surrogate everywhere, in
  whatever spelling or format. Given name and surname are replaced each, so the full
  name, the title with the surname and the bare surname agree.
* Distinctness: the distinct cores of the corpus get candidate surrogates; those
  that meet another core's candidate or any real core are drawn again with the
  next attempt, until none is left; after ``WIDEN`` attempts they get longer than the
  form. A core and its surrogate meet in a shuffle
  join, so an entity that a third of all documents hold is split as a skewed join.

The key is a parameter; surrogates can't be traced back without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlens.llm.shared import free_name, keep, row_key

KEY = "surrogates-2024"
ATTEMPTS = 64
#: From this attempt on a surrogate gets one more digit each time: its form has hardly a free value.
WIDEN = 8
#: Attempts at a given name from the list alone.
PLAIN = 4

# Forms of address by gender, and name parts of surrogates.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Señorita", "Госпожа")
MALE_TITLES = ("Mr", "Mister", "Herr", "Monsieur", "Sr", "Señor", "Господин")
FEMALE_NAMES = ("Anna", "Clara", "Elena", "Greta", "Helen", "Ines", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sofia", "Teresa", "Vera")
MALE_NAMES = ("Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Martin", "Oscar", "Paul", "Simon")
FEMALE_NAMES_CYRILLIC = ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Ольга")
MALE_NAMES_CYRILLIC = ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Максим", "Павел")
SYLLABLES = ("ba", "den", "for", "gar", "hol", "ker", "lan", "mor", "nel", "per", "ros", "san", "tal", "ver", "win", "zel")
SYLLABLES_CYRILLIC = ("ба", "ден", "фор", "гар", "хол", "кер", "лан", "мор", "нел", "пер", "рос", "сан", "тал", "вер", "вин", "зел")

_TITLE = "|".join(sorted(FEMALE_TITLES + MALE_TITLES, key=len, reverse=True))
# the domain ends at its last label that can be a top level; a name has 127 labels at most
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
# cheap tests come first: a quote, sign or space before, and one of the signs near
_SECRET = r"(?<=[=:\s\"'])(?<=[=:][\s\"']{0,4})(?<=(?:token|password|passwd|secret|api_key|apikey|access_key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_+/-]{6,}"
_KEY_ID = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?:sk-|ghp_)[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])"
_IP = r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?!\.?[0-9])"
_CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?|[0-9]{1,4}[ .-]?)(?:[0-9]{2,4}[ .-]?){1,4}[0-9]{2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"
# a name after its form of address, which is the group
_NAME = rf"(?=\p{{Lu}}[\p{{L}}'’-])(?<=\x20)(?<=(?<![\p{{L}}])({_TITLE})(?:\.|)\x20)\p{{Lu}}[\p{{L}}'’-]++(?: \p{{Lu}}[\p{{L}}'’-]++)?"
ENTITY = "|".join((_EMAIL, _SECRET, _KEY_ID, _IP, _SSN, _IBAN, _CARD, _PHONE))
TITLED = rf"(?=[{''.join(sorted({t[0] for t in FEMALE_TITLES + MALE_TITLES}))}])(?:{_TITLE})(?:\.|) \p{{Lu}}"
MAYBE = rf"[0-9@=:]|sk-|ghp_|AKIA|{TITLED}"


def name_words(body: Column) -> Column:
    """The words of the names after a form of address: word, given (the first of two),
    female (by the form of address)."""
    names, titles = (F.regexp_extract_all(body, F.lit(_NAME), F.lit(g)) for g in (0, 1))
    found = F.when(body.rlike(TITLED), F.arrays_zip(names.alias("name"), titles.alias("title"))).otherwise(F.array().cast("array<struct<name:string,title:string>>"))

    def parts(x: Column) -> Column:
        of = F.filter(F.split(x["name"], " "), lambda w: ~w.isin(*FEMALE_TITLES, *MALE_TITLES))
        return F.transform(of, lambda w, j: F.struct(
            F.regexp_replace(w, "(?:['’]s|['’-]+)$", "").alias("word"), ((F.size(of) == 2) & (j == 0)).alias("given"), x["title"].isin(*FEMALE_TITLES).alias("female")))

    return F.filter(F.flatten(F.transform(found, parts)), lambda x: F.length(x["word"]) > 1)


def entity_pattern(words: Column, pairs: bool = False) -> Column:
    """The pattern of all entities of a text whose name words are ``words`` (joined by
    bars; they hold letters, apostrophes and hyphens only); with ``pairs`` two words
    with a space between are one entity."""
    word = F.concat(F.lit(r"(?<![\p{L}])(?=\p{Lu})(?:"), words, F.lit(r")(?![\p{L}])"))
    names = F.concat(word, F.lit("(?: "), word, F.lit(")?")) if pairs else word
    return F.when(words != "", F.concat(F.lit(ENTITY + "|"), names)).otherwise(F.lit(ENTITY))


def entity_type(entity: Column) -> Column:
    """The type of a match, from its form alone."""
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(r"^(?:AKIA[0-9A-Z]{16}|(?:sk-|ghp_)[A-Za-z0-9]{16,})$"), "key")
        .when(entity.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(entity.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(entity.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){2,}$"), "iban")
        .when(entity.rlike(r"^[0-9]{13,19}$|^[0-9]{4}[ -][0-9]{4,6}[ -][0-9 -]+$"), "card")
        .when(entity.rlike(r"^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), "phone")
        .when(entity.rlike(r"^\p{Lu}[\p{L}'’-]*(?: \p{Lu}[\p{L}'’-]*)?$"), "name")
        .otherwise("secret")
    )


def entity_core(kind: Column, entity: Column) -> Column:
    """What coreferent spellings share: for numbers their letters and digits, for
    the others the lower case form (secrets and keys are case-sensitive)."""
    return (
        F.when(kind.isin("ssn", "iban", "card", "phone"), F.regexp_replace(entity, "[^0-9A-Za-z]", ""))
        .when(kind.isin("secret", "key"), entity)
        .otherwise(F.lower(entity))
    )


def _draw(seed: Column, at: Column, n: int) -> Column:
    """A number below ``n``: keyed by the seed (a digest), for one position."""
    return F.pmod(F.xxhash64(seed, at), F.lit(n)).cast("int")


def _letter(alphabet: str, seed: Column, at: Column) -> Column:
    return F.substring(F.lit(alphabet), _draw(seed, at, len(alphabet)) + 1, F.lit(1))


def _luhn(digits: Column) -> Column:
    """Check sum modulo 10 of a digit string (0: the check digit is right)."""
    size = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((size - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10


def _same_form(core: Column, seed: Column, fixed: Column, hexadecimal: Column | None = None) -> Column:
    """Every character from the one-based position ``fixed`` on replaced by one
    of its own class."""
    chars = F.transform(F.sequence(F.lit(1), F.length(core)), lambda i: F.struct(i.alias("i"), F.substring(core, i, F.lit(1)).alias("c")))

    def one(x: Column) -> Column:
        c, i = x["c"], x["i"]
        lower, upper = _letter("abcdefghijklmnopqrstuvwxyz", seed, i), _letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", seed, i)
        if hexadecimal is not None:
            lower = F.when(hexadecimal, _letter("abcdef", seed, i)).otherwise(lower)
            upper = F.when(hexadecimal, _letter("ABCDEF", seed, i)).otherwise(upper)
        return (F.when(i < fixed, c).when(c.between("0", "9"), _letter("0123456789", seed, i))
                .when(c.between("a", "z"), lower).when(c.between("A", "Z"), upper).otherwise(c))

    return F.array_join(F.transform(chars, one), "")


def _pick(options: tuple[str, ...], seed: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), _draw(seed, F.lit(at), len(options)) + 1)


def surrogate_core(kind: Column, core: Column, gender: Column, seed: Column, attempt: Column) -> Column:
    """The candidate surrogate of a core (see the module's list of forms)."""
    digits = _same_form(core, seed, F.lit(2))
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    check = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(_luhn(core) == 0, F.concat(body, check)).otherwise(digits)
    # the last label of an address stays
    suffix = F.regexp_extract(core, r"(\.[a-z]+)$", 1)
    host = F.substring(core, F.lit(1), F.length(core) - F.length(suffix))
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    cyrillic = core.rlike(r"\p{IsCyrillic}")
    female = gender == "f"

    def syllables(options: tuple[str, ...], n: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(F.array(*map(F.lit, options)), _draw(seed, i + 9, len(options)) + 1))
        return F.array_join(parts, "")

    def given(options_f: tuple[str, ...], options_m: tuple[str, ...], ends: tuple[str, ...]) -> Column:
        first = F.when(female, _pick(options_f, seed, 1)).otherwise(_pick(options_m, seed, 1))
        # the list is short: later candidates are longer names
        return F.when(attempt < PLAIN, first).otherwise(F.concat(first, syllables(ends, F.greatest(attempt - PLAIN, F.lit(0)) + 1)))

    hexadecimal = core.rlike("^[0-9a-fA-F]+$")
    prefix = F.length(F.regexp_extract(core, "^(AKIA|sk-|ghp_)", 1)) + 1
    return (
        F.when(kind == "email", F.concat(_same_form(host, seed, F.lit(1)), suffix))
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "iban", _same_form(core, seed, F.lit(3)))
        .when(kind == "phone", _same_form(core, seed, F.when(F.length(core) > 10, F.length(core) - 9).otherwise(F.lit(1))))
        .when(kind == "ssn", _same_form(core, seed, F.lit(1)))
        .when(kind == "key", _same_form(core, seed, prefix))
        .when(kind == "given", F.when(cyrillic, given(FEMALE_NAMES_CYRILLIC, MALE_NAMES_CYRILLIC, SYLLABLES_CYRILLIC)).otherwise(given(FEMALE_NAMES, MALE_NAMES, SYLLABLES)))
        .when(kind == "surname", F.initcap(F.when(cyrillic, syllables(SYLLABLES_CYRILLIC, attempt + 2)).otherwise(syllables(SYLLABLES, attempt + 2))))
        .otherwise(_same_form(core, seed, F.lit(1), hexadecimal))
    )


def _widened(kind: Column, new: Column, seed: Column, more: int) -> Column:
    """A candidate with so many more digits, before an address's last label (names
    get longer by themselves, and IP addresses have values enough)."""
    extra = F.concat(*(_letter("0123456789", seed, F.lit(-1 - i)) for i in range(more)))
    return (F.when(kind.isin("ip", "given", "surname"), new)
            .when(kind == "email", F.regexp_replace(new, F.lit(r"(\.[a-z]+)$"), F.concat(extra, F.lit("$1"))))
            .otherwise(F.concat(new, extra)))


def _formatted(kind: Column, entity: Column, new: Column) -> Column:
    """A surrogate core in the format of one spelling: separators where they
    were, upper case where letters were, what is longer at the end."""
    def put(i: Column) -> Column:
        c = F.substring(entity, i, F.lit(1))
        rank = F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substring(new, rank, F.lit(1))).otherwise(c)

    def case(i: Column) -> Column:
        c, d = F.substring(entity, i, F.lit(1)), F.substring(new, i, F.lit(1))
        return F.when(c != F.lower(c), F.upper(d)).otherwise(d)

    places = F.sequence(F.lit(1), F.length(entity))
    return (
        F.when(kind.isin("ssn", "iban", "card", "phone"), F.concat(F.array_join(F.transform(places, put), ""), F.substring(new, F.length(entity_core(kind, entity)) + 1, F.length(new))))
        .when(kind == "email", F.concat(F.array_join(F.transform(places, case), ""), F.substring(new, F.length(entity) + 1, F.length(new))))
        .when(kind.isin("given", "surname") & (entity == F.upper(entity)), F.upper(new))
        .otherwise(new)
    )


def assign_surrogates(cores: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, core, gender) -> (kind, core, new), one row per kind and core; no
    two cores of a kind get the same surrogate, and none gets a real core."""
    real = keep(cores.groupBy("kind", "core").agg(F.max("gender").alias("gender")), "pii-cores")
    done: DataFrame | None = None
    todo = real
    for attempt in range(ATTEMPTS):
        seed = F.sha2(F.concat_ws("|", F.lit(key), "kind", "core", F.lit(str(attempt))), 256)
        seeded = todo.withColumn("seed", seed)
        drawn = seeded.withColumn("new", surrogate_core(F.col("kind"), F.col("core"), F.col("gender"), F.col("seed"), F.lit(attempt)))
        if attempt >= WIDEN:
            drawn = drawn.withColumn("new", _widened(F.col("kind"), F.col("new"), F.col("seed"), attempt - WIDEN + 1))
        drawn = drawn.select("kind", "core", "gender", "new", F.lower("new").alias("as_core"))
        # a candidate goes to the smallest core that drew it, unless it is real or given away
        first = drawn.groupBy("kind", "as_core").agg(F.min("core").alias("core"))
        first = first.join(real.select("kind", F.lower("core").alias("as_core")).distinct(), ["kind", "as_core"], "left_anti")
        if done is not None:
            first = first.join(done.select("kind", F.lower("new").alias("as_core")), ["kind", "as_core"], "left_anti")
        drawn = keep(drawn.join(first.select("kind", "core", F.lit(True).alias("own")), ["kind", "core"], "left"), "pii-drawn")
        good = drawn.filter("own").select("kind", "core", "new")
        done = good if done is None else done.union(good)
        todo = drawn.filter("own is null").select("kind", "core", "gender")
        if todo.isEmpty():
            return done
    raise ValueError(f"no free surrogates for some entities after {ATTEMPTS} attempts")


def replace_pii(docs: DataFrame, text: str = "text", key: str = KEY, count: str | None = None, length: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced by its surrogate; all
    other columns as they are. ``count`` names a new column for the number of
    replaced entities, ``length`` an existing one that gets the new number of
    code points where a text has changed.

    Null and empty texts stay. Repeated texts are searched once and get the same
    result. An empty table stays empty. New helper columns avoid the names that
    ``docs`` has."""
    at, of_text, news_of, words_of, n_of = (free_name(docs, x) for x in ("pii_key", "pii_text", "pii_news", "pii_words", "pii_n"))
    names = [F.col(c) for c in docs.columns]
    body = F.col(text)
    maybe = F.coalesce(body.rlike(MAYBE), F.lit(False))
    keyed = docs.filter(maybe).withColumn(at, row_key(text))
    found = keyed.select(F.col(at).alias("k"), body.alias("body"), name_words(body).alias("names"))
    each_word = F.array_distinct(F.transform("names", lambda x: x["word"]))
    longest_first = F.array_sort(each_word, lambda a, b: F.length(b) - F.length(a))
    found = found.select("k", "body", "names", F.array_join(longest_first, "|").alias("words"))

    def words_that(test) -> Column:
        return F.transform(F.filter("names", test), lambda x: x["word"])

    entities = F.regexp_extract_all("body", entity_pattern(F.col("words")), F.lit(0))
    n_found = F.when(F.col("words") != "", F.size(F.regexp_extract_all("body", entity_pattern(F.col("words"), True), F.lit(0)))).otherwise(F.size("entities"))
    found = found.select("k", "body", "words", entities.alias("entities"), words_that(lambda x: ~x["given"]).alias("surnames"),
                         words_that(lambda x: x["given"]).alias("given"), words_that(lambda x: x["female"]).alias("female"))
    hits = F.transform("entities", lambda e: F.struct(
        e.alias("entity"), F.when(F.array_contains("surnames", e), "surname").when(F.array_contains("given", e), "given").otherwise("").alias("role"),
        F.when(F.array_contains("female", e), "f").otherwise("m").alias("gender")))
    found = found.filter(F.size("entities") > 0).select("k", "words", n_found.alias("n"), hits.alias("hits"))
    found = keep(found.groupBy("k").agg(F.first("words").alias("words"), F.first("n").alias("n"), F.first("hits").alias("hits")), "pii-found")
    # what is a text's goes with its first entity
    each = found.select("k", "words", "n", F.posexplode("hits").alias("i", "hit")).select(
        "k", "i", F.when(F.col("i") == 0, F.col("words")).alias("words"), F.when(F.col("i") == 0, F.col("n")).alias("n"), "hit.entity", "hit.role", "hit.gender")
    form = entity_type(F.col("entity"))
    kind = F.when(F.col("role") != "", F.col("role")).when(form == "name", "secret").otherwise(form)
    each = each.withColumn("kind", kind).withColumn("core", entity_core(F.col("kind"), F.col("entity")))
    given = assign_surrogates(each.select("kind", "core", "gender"), key)
    put = each.join(given, ["kind", "core"]).select("k", "i", "words", "n", _formatted(F.col("kind"), F.col("entity"), F.col("new")).alias("new"))
    news = put.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]).alias(news_of),
                                F.max("words").alias(words_of), F.max("n").alias(n_of))
    joined = keyed.join(news.withColumnRenamed("k", of_text), F.col(at) == F.col(of_text), "left")
    pieces = F.split(body, entity_pattern(F.coalesce(F.col(words_of), F.lit(""))), -1)
    changed = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.try_element_at(F.col(news_of), (i + 1).cast("int")), F.lit("")))), "")
    new_text = F.when(F.col(news_of).isNull(), body).otherwise(changed)
    n = F.col(n_of)

    def columns(text_col: Column, n_col: Column, changes: Column) -> list[Column]:
        out = []
        for c, col in zip(docs.columns, names):
            if c == text:
                out.append(text_col.alias(c))
            elif c == length:
                out.append(F.when(changes, F.length(text_col).cast(docs.schema[c].dataType)).otherwise(col).alias(c))
            else:
                out.append(col)
        return out + ([n_col.alias(count)] if count else [])

    with_hits = joined.select(*columns(new_text, F.when(F.col(news_of).isNull(), F.lit(0)).otherwise(n).cast("long"), F.col(news_of).isNotNull()))
    return with_hits.unionByName(docs.filter(~maybe).select(*columns(body, F.lit(0).cast("long"), F.lit(False))))
