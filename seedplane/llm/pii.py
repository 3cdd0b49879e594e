"""PII surrogates, with DataFrame functions only.

One pattern finds the entities of a text: e-mail addresses, IPv4 addresses, phone numbers, card and account
numbers, IBANs, social security numbers, IPv6 addresses, secrets, and names behind a title (then also the whole
name and the family name alone wherever else they stand in that text; of two of one family the one that sorts last). Each distinct entity (by type
and canonical form, so spelling variants corefer) gets one surrogate, derived from a keyed SHA-256 digest:
digits for digits, letters of the same case and script for letters, separators kept; addresses stay
addresses (IPs in the private 10.0.0.0/8 range, e-mails at reserved example domains), card numbers keep
their first digit and pass or fail the Luhn test as before, IBANs keep their country and get the right
check digits, and names take a name of the title's gender in the name's script.

Collision checks run over all distinct entities at once: of the entities that want one surrogate the first
keeps it, a surrogate that is an original (its own or another's) or taken is refused, and the others try
again with the next digest; from ``WIDE`` tries on the surrogate's space is widened. So two entities never
share a surrogate, and one entity has the same everywhere. If tries run out, an error says so.

Only texts that can have entities (a digit, an @, a title) are shuffled; the map from entity to surrogate is joined, never collected, and a
hot entity's rows are dealt by Spark's skew-join handling.

Edge cases: null text stays null, empty stays empty; texts without entities pass unchanged; repeated rows
are treated alike; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

TRIES = 24
WIDE = 8

#: Titles by the gender they state, and names by gender and script.
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra Señorita Signora Doña Госпожа Κυρία", "m": "Mr Mister Herr Monsieur Señor Sr Signor Don Господин Κύριος", "n": "Dr Prof Mx"}
NAMES = {
    ("f", "latin"): "Agnes Beatrix Celia Dorothea Edith Felicia Greta Helena Ida Johanna Klara Lucia Martha Nora Olivia Paula Rosa Sophia Thea Ursula Viola Wilma",
    ("m", "latin"): "Adrian Bruno Conrad Damian Edgar Felix Gustav Hugo Ivan Julius Kaspar Leo Magnus Norbert Oskar Paul Quentin Rufus Simon Theo Viktor Walter",
    ("n", "latin"): "Alex Blake Casey Dana Eden Finley Gray Harper Indigo Jules Kim Lane Marlow Noel Oakley Perry Quinn Robin Sage Taylor Vale Wren",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Софья",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Лев Максим Олег Павел Юрий",
    ("f", "greek"): "Άννα Δήμητρα Ελένη Ζωή Ιωάννα Μαρία Σοφία Χλόη",
    ("m", "greek"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος Στέφανος",
}
FAMILY_PARTS = {"latin": ("Al Ber Cor Dan Fal Gar Hol Kel Lan Mor Nor Par Ros Sel Tor Wal", "den ler man mer nik rik sen ston ter tin vik wood"), "cyrillic": ("Бел Вол Гор Дроз Зим Крас Лес Мор Нов Пол Сав Тих", "анов енко ин овский ов ский"), "greek": ("Αλεξ Βασιλ Γεωργ Δημ Κων Νικ Παπ Στεφ", "άκης ίδης όπουλος ιάδης έλλης")}

_title = "|".join(t for ts in TITLES.values() for t in ts.split())
#: type -> pattern, in order of precedence.
PATTERNS = {
    "EMAIL": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "SECRET": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho)[-_][A-Za-z0-9]{20,128})(?![A-Za-z0-9])",
    "IBAN": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "PHONE": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+./-])0[1-9][0-9]{1,3}[ /-][0-9]{5,8}(?![0-9A-Za-z./-])",
    "SSN": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "IP": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])",
    "IP6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:])",
    "CARD": r"(?<![0-9A-Za-z.+-])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|(?!(?:19|20)[0-9]{2}[ -](?:19|20)[0-9]{2})[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,4}(?:[ -][0-9]{1,3})?)(?![0-9A-Za-z])",
    "NAME": rf"(?<![\p{{L}}\p{{N}}])(?:{_title})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every text with an entity has somewhere; far cheaper to look for than the entities.
HINT = rf"[0-9@]|[A-Fa-f]:|(?:AKIA|sk|pk|ghp|gho)[-_A-Z0-9]|(?=[{''.join(sorted({t[0] for ts in TITLES.values() for t in ts.split()}))}])(?:{_title})\.? \p{{Lu}}"


def type_of(value: Column) -> Column:
    out = F.lit("NAME")
    for name, pattern in reversed(PATTERNS.items()):
        if name != "NAME":
            out = F.when(F.regexp_like(value, F.lit(f"^(?:{pattern})$")), F.lit(name)).otherwise(out)
    return out


def canonical(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind.isin("EMAIL", "IP6"), F.lower(value)).when(kind.isin("PHONE", "SSN", "CARD"), digits).when(kind == "IBAN", F.regexp_replace(value, " ", ""))
        .when(kind == "NAME", F.regexp_replace(F.regexp_replace(value, rf"^(?:{_title})\.? ", ""), " +", " ")).otherwise(value)
    )


def _digest(key: str, kind: Column, value: Column, attempt: int) -> Column:
    """256 hex digits that only the key tells."""
    block = lambda i: F.sha2(F.concat_ws("\u0001", F.lit(f"{key}|{attempt}|{i}"), kind, value, F.lit(key)), 256)
    return F.concat(*[block(i) for i in range(4)])


def _number(digest: Column, at: Column | int, modulus: int) -> Column:
    """A number below modulus from four hex digits."""
    start = (F.lit(at) if isinstance(at, int) else at) % 63 * 4 + 1
    return (F.conv(F.substring(digest, start, F.lit(4)), 16, 10).cast("long") % modulus).cast("int")


def _shaped(value: Column, digest: Column, hex_only: Column) -> Column:
    """Every digit and letter replaced by one of its kind."""
    pick = lambda letters, i: F.substring(F.lit(letters), _number(digest, i, len(letters)) + 1, F.lit(1))

    def one(c, i):
        return (
            F.when(c.rlike("^[0-9]$"), _number(digest, i, 10).cast("string")).when(hex_only & c.rlike("^[a-f]$"), pick("abcdef", i)).when(hex_only & c.rlike("^[A-F]$"), pick("ABCDEF", i))
            .when(c.rlike("^[a-z]$"), pick("abcdefghijklmnopqrstuvwxyz", i)).when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum modulo 10, the last digit counting once."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _card(value: Column, shaped: Column, digest: Column) -> Column:
    body = F.concat(F.substring(value, 1, 1), F.substring(shaped, F.lit(2), F.length(value) - 2))
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    moved = F.when(_luhn(value) == 0, F.lit(0)).otherwise(1 + _number(digest, 60, 9))  # a wrong digit for a wrong one
    return F.concat(body, ((check + moved) % 10).cast("string"))


def _iban(value: Column, shaped: Column) -> Column:
    body = F.substring(shaped, F.lit(5), F.length(value))
    moved = F.concat(body, F.substring(value, 1, 2), F.lit("00"))
    expanded = F.flatten(F.transform(F.split(moved, ""), lambda c: F.split(F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c), "")))
    rest = F.aggregate(expanded, F.lit(0), lambda a, c: (a * 10 + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))) % 97)
    return F.concat(F.substring(value, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _name(value: Column, gender: Column, digest: Column, more: int) -> Column:
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.when((script != "latin") & (gender != "f"), "m").otherwise(gender)  # the lists there are f and m
    out = F.lit(None).cast("string")
    parts = F.size(F.split(value, " "))
    for (g, s), names in NAMES.items():
        names = names.split()
        a, b = (x.split() for x in FAMILY_PARTS[s])
        pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), _number(digest, at, len(words)) + 1)
        family = F.concat(pick(a, 1), *[F.lower(pick(a, 3 + i)) for i in range(more)], pick(b, 2))
        made = F.when(parts > 1, F.concat(pick(names, 0), F.lit(" "), family)).otherwise(family)
        out = F.when((script == s) & (gender == g), made).otherwise(out)
    return out


def shape_of(kind: Column, value: Column, d: Column) -> Column:
    """The value (of an e-mail address the part before the @) with every character replaced by one of its kind."""
    return _shaped(F.when(kind == "EMAIL", F.substring_index(value, "@", 1)).otherwise(value), d, ((kind == "SECRET") & value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")) | (kind == "IP6"))


def surrogate(kind: Column, value: Column, gender: Column, d: Column, shaped: Column, attempt: int) -> Column:
    """The wish of an entity, from its digest d and its shape (columns, as they are read many times over)."""
    wide = attempt >= WIDE
    domain = F.element_at(F.array(*[F.lit(x) for x in ("example.com", "example.net", "example.org")]), _number(d, 62, 3) + 1)
    extra = F.substring(d, 200, 8) if wide else F.lit("")
    octet = lambda at: _number(d, at, 254) + 1
    first = _number(d, 9, 222) + 1 if wide else F.lit(10)
    return (
        F.when(kind == "EMAIL", F.concat(shaped, extra, F.lit("@"), domain)).when(kind == "IP", F.concat_ws(".", first, octet(1), octet(2), octet(3))).when(kind == "CARD", _card(value, shaped, d)).when(kind == "IBAN", _iban(value, shaped))
        .when(kind == "PHONE", F.concat(F.substring(value, 1, 1), F.substring(shaped, F.lit(2), F.length(value)))).when(kind == "NAME", _name(value, gender, d, max(0, attempt - WIDE + 1))).otherwise(shaped)
    )


def _restored(kind: Column, original: Column, made: Column) -> Column:
    """The surrogate in the original's own layout."""
    def at(i):
        return F.length(F.regexp_replace(F.substring(original, F.lit(1), i + 1), "[^0-9]", ""))
    digits = F.array_join(F.transform(F.split(original, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(made, at(i), F.lit(1))).otherwise(c)), "")
    spaced = lambda i: F.length(F.regexp_replace(F.substring(original, F.lit(1), i + 1), " ", ""))
    iban = F.array_join(F.transform(F.split(original, ""), lambda c, i: F.when(c != " ", F.substring(made, spaced(i), F.lit(1))).otherwise(c)), "")
    title = F.regexp_extract(original, rf"^(?:{_title})\.? ", 0)
    return F.when(kind.isin("PHONE", "SSN", "CARD"), digits).when(kind == "IBAN", iban).when(kind == "NAME", F.concat(title, made)).otherwise(made)


def gender_of(value: Column) -> Column:
    out = F.lit("n")
    for g in ("m", "f"):
        out = F.when(value.rlike(rf"^(?:{'|'.join(TITLES[g].split())})\.? "), F.lit(g)).otherwise(out)
    return out


def surrogate_map(entities: DataFrame, key: str, tries: int = TRIES) -> DataFrame:
    """kind, value, made for every distinct (kind, value) of entities (kind, value, gender); distinct per kind."""
    waiting = written(entities.groupBy("kind", "value").agg(F.min("gender").alias("gender")), "entities")
    originals = waiting.select("kind", F.col("value").alias("made"))
    taken = None
    for attempt in range(tries):
        wish = waiting.withColumn("__d", _digest(key, F.col("kind"), F.col("value"), attempt))
        wish = wish.withColumn("__s", shape_of(F.col("kind"), F.col("value"), F.col("__d")))
        wish = wish.select("kind", "value", "gender", surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.col("__d"), F.col("__s"), attempt).alias("made"))
        barred = originals if taken is None else originals.unionByName(taken.select("kind", "made"))
        free = wish.join(barred, ["kind", "made"], "left_anti")
        firsts = free.groupBy("kind", "made").agg(F.min("value").alias("value"))
        chosen = firsts.select("kind", "value", "made")
        last, taken = taken, written(chosen if taken is None else taken.unionByName(chosen), "surrogates")
        dropped(last)
        rest = waiting.join(taken, ["kind", "value"], "left_anti")
        if rest.limit(1).count() == 0:
            return taken
        if attempt == 0:
            originals = written(originals, "originals")
        last, waiting = waiting, written(rest, "entities")
        dropped(last)
    raise ValueError(f"no free surrogate after {tries} tries")


def pseudonymised(documents: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with every detected entity of text_col replaced, and nothing else changed."""
    if not key or not key.strip():
        raise ValueError("a key is needed")
    columns = documents.columns
    text = F.col(text_col).cast("string")
    has = F.coalesce(F.regexp_like(text, F.lit(HINT)), F.lit(False))
    marked = documents.withColumn("__has", has)
    touched = written(marked.filter("__has").drop("__has").withColumns({"__row": F.monotonically_increasing_id(), "__found": F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))}), "entity-texts")
    each = touched.select("__row", F.posexplode("__found").alias("at", "original"))
    each = each.withColumn("kind", type_of(F.col("original"))).withColumn("value", canonical(F.col("kind"), F.col("original"))).withColumn("gender", F.when(F.col("kind") == "NAME", gender_of(F.col("original"))))
    # a bare run of digits is a card number only if its check digit is right
    no_card = (F.col("kind") == "CARD") & ~F.col("original").rlike("[ -]") & (_luhn(F.col("value")) != 0)
    each = written(each.withColumn("kind", F.when(~no_card, F.col("kind"))), "entity-rows")
    made = surrogate_map(each.filter("kind is not null").select("kind", "value", "gender"), key)
    replaced = each.join(made, ["kind", "value"], "left").withColumn("new", F.coalesce(_restored(F.col("kind"), F.col("original"), F.col("made")), F.col("original")))
    # what a name that was found once is called elsewhere in its text: the whole name, the family name alone
    name, family = (F.when(F.col("kind") == "NAME", x) for x in (F.struct("value", "made"), F.struct(F.substring_index("value", " ", -1).alias("value"), F.substring_index("made", " ", -1).alias("made"))))
    replaced = replaced.select("__row", "at", "new", F.filter(F.array(name, family), lambda x: x.isNotNull() & (F.length(x["value"]) > 2)).alias("called"))
    lists = replaced.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("at", "new", "called"))).alias("__new"))  # bounded by a text's own entities
    mentions = F.flatten(F.transform("__new", lambda x: x["called"]))
    quoted = lambda v: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), v, F.lit(r"\E(?![\p{L}\p{N}])"))
    longest_first = F.reverse(F.array_sort(F.transform(F.array_distinct(mentions), lambda x: F.struct(F.length(x["value"]).alias("n"), x["value"].alias("value"), x["made"].alias("made")))))
    named = lambda gap: F.aggregate(longest_first, gap, lambda a, x: F.regexp_replace(a, quoted(x["value"]), x["made"]))
    gaps = F.split(text, ANY, -1)
    gaps = F.when(F.coalesce(F.size(mentions), F.lit(0)) > 0, F.transform(gaps, named)).otherwise(gaps)
    woven = F.array_join(F.flatten(F.zip_with(gaps, F.concat(F.coalesce(F.transform("__new", lambda x: x["new"]), F.array().cast("array<string>")), F.array(F.lit(""))), lambda gap, new: F.array(gap, F.coalesce(new, F.lit(""))))), "")
    done = touched.join(lists, "__row", "left").withColumn(text_col, woven).select(*[f"`{c}`" for c in columns])
    return marked.filter(~F.col("__has")).select(*[f"`{c}`" for c in columns]).unionByName(done)
