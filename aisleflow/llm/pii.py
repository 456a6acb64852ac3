"""Personal data replaced by keyed, type-consistent surrogates. DataFrame functions only.

Mentions are found by one pattern. A mention has parts: an address its local part and its domain, a
name its given name and surname, everything else one part. Each distinct part of the corpus gets one
surrogate, derived from a keyed hash, of the same kind and shape; surrogates that meet each other or
a real part are derived anew until all are distinct. Mentions are put together from their parts'
surrogates, so equal parts stay equal in every document and different ones stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aisleflow.llm.storage import drop, materialize, without

# Titles and given names that announce a person, by gender.
TITLES = {"f": "Mrs Ms Miss Frau Mme Sra Señora Госпожа", "m": "Mr Herr Sr Señor Господин", "u": "Dr Prof"}
GIVEN = {
    "f": "Mary Jennifer Linda Elizabeth Susan Jessica Sarah Karen Emily Emma Sophie Julie Camille Ursula Sabine Petra María Carmen Lucía Анна Мария Елена Ольга Наталья",
    "m": "James John Robert Michael William David Richard Thomas Daniel Peter Pierre Jean Jacques Hans Klaus Jürgen José Carlos Javier Иван Сергей Алексей Дмитрий Михаил",
}
_any = lambda lists: "|".join(" ".join(lists.values()).split())

WORD = r"\p{Lu}[\p{L}'’-]+"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![A-Za-z])(?:[Tt]oken|[Pp]assword|[Pp]asswd|[Ss]ecret|[Aa]pi[_-]?[Kk]ey|TOKEN|PASSWORD|SECRET|API_KEY) {0,2}[=:] {0,2}[\"']?[^\s\"',;]{6,}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:(?:{_any(TITLES)})\.? {WORD}(?: {WORD})?|(?:{_any(GIVEN)}) {WORD})",
}
_lettered, _numbered = ("email", "secret", "key", "name"), ("phone", "ssn", "ip", "card")
#: The kinds in two groups, so that inside a word of prose one look at the letter before is enough.
PATTERN = rf"(?<![A-Za-z])(?:{'|'.join(KINDS[k] for k in _lettered)})|(?=[0-9+(])(?:{'|'.join(KINDS[k] for k in _numbered)})"
#: A text without any of these has no mention.
HINT = rf"[0-9@=:]|\p{{Lu}}\p{{Ll}}+ \p{{Lu}}[\p{{L}}'’-]|(?:{_any(TITLES)})\. "
LABEL = r"^.*?[=:] {0,2}[\"']?"


def mentions(text: Column) -> Column:
    """The mentions of a text, in order."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in KINDS if k != "name"]):
        out = F.when(mention.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def _part(kind: Column | str, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))


def parts_of(kind: Column, mention: Column) -> Column:
    """array<struct<kind, value>>: what identifies the mention's parts."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    words = F.regexp_replace(mention, rf"^(?:{_any(TITLES)})\.? ", "")
    has_title = mention.rlike(rf"^(?:{_any(TITLES)})\.? ")
    first, second = F.split_part(words, F.lit(" "), F.lit(1)), F.split_part(words, F.lit(" "), F.lit(2))
    listed = lambda w, g, names: w.rlike(f"^(?:{'|'.join(names[g].split())})(?:\\.?$|\\.? )")
    gender = F.when(listed(mention, "f", TITLES), "f").when(listed(mention, "m", TITLES), "m").when(listed(first, "f", GIVEN), "f").when(listed(first, "m", GIVEN), "m").otherwise("u")
    surname = _part("surname", F.lower(F.when(second == "", first).otherwise(second)))
    given = _part(F.concat(F.lit("given_"), gender), F.lower(first))
    # a listed given name alone after a title is a given name
    person = F.when(second != "", F.array(given, surname)).when(has_title & (listed(first, "f", GIVEN) | listed(first, "m", GIVEN)), F.array(given)).otherwise(F.array(surname))
    return (
        F.when(kind == "email", F.array(_part("local", F.lower(F.split_part(mention, F.lit("@"), F.lit(1)))), _part("domain", F.lower(F.split_part(mention, F.lit("@"), F.lit(2))))))
        .when(kind == "phone", F.array(_part("phone", F.substring(digits, -10, 10))))
        .when(kind.isin("ssn", "card"), F.array(_part(kind, digits)))
        .when(kind == "secret", F.array(_part("secret", F.regexp_replace(mention, LABEL, ""))))
        .when(kind == "name", person)
        .otherwise(F.array(_part(kind, mention)))
    )


def _luhn_digit(body: Column) -> Column:
    """The check digit of a string of digits."""
    n = F.length(body)

    def step(total: Column, i: Column) -> Column:
        d = body.substr(n - i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, d * 2).otherwise(d)
        return total + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _shaped(value: Column, stream: Column, keep: Column | None = None) -> Column:
    """``value`` with each ASCII letter and digit replaced by one of its own class from a hex stream;
    the tail ``keep`` stays."""
    n = F.length(value) - (F.length(keep) if keep is not None else 0)
    hexes = value.rlike("^[0-9a-f]+$") & value.rlike("[0-9]") & value.rlike("[a-f]")

    def one(i: Column) -> Column:
        c = value.substr(i, F.lit(1))
        at = stream.substr((i * 2) % F.length(stream) + 1, F.lit(2))
        r = F.conv(at, 16, 10).cast("int")
        return (
            F.when(i > n, c).when(hexes, F.substr(F.lit("0123456789abcdef"), r % 16 + 1, F.lit(1)))
            .when(c.rlike("[0-9]"), (r % 10).cast("string")).when(c.rlike("[a-z]"), F.char(r % 26 + 97)).when(c.rlike("[A-Z]"), F.char(r % 26 + 65)).otherwise(c)
        )

    return F.when(F.length(value) == 0, value).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), one), ""))


def _syllables(digest: Column, script: dict[str, str], n: int) -> Column:
    """A name of ``n`` syllables and a closing letter, by its letters' script."""
    pick = lambda letters, at: F.substr(F.lit(letters), F.conv(digest.substr(F.lit(at), F.lit(2)), 16, 10).cast("int") % len(letters) + 1, F.lit(1))
    return F.concat(*[pick(script[kind], 4 * s + 2 * k + 1) for s in range(n) for k, kind in enumerate(("c", "v"))])


# Letters of invented names by script, and how given names of each gender end.
LATIN = {"c": "bcdfghklmnprstvz", "v": "aeiou", "f": "na", "m": "ton", "u": "re"}
CYRILLIC = {"c": "бвгдзклмнпрстф", "v": "аеиоу", "f": "на", "m": "тор", "u": "ре"}


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a part. Later attempts give other ones, names and addresses with more letters."""
    seed = F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"))
    digest = F.sha2(seed, 256)
    stream = F.concat(digest, F.sha2(F.concat(seed, F.lit("|more")), 256))
    digits = F.translate(stream, "abcdef", "173951")
    more = F.substr(F.regexp_replace(F.sha2(F.concat(seed, F.lit("|tail")), 512), "[0-9]", ""), F.lit(1), attempt)
    octet = lambda at, base, n: (F.conv(digest.substr(F.lit(at), F.lit(4)), 16, 10).cast("int") % n + base).cast("string")
    n = F.length(value)
    body = F.concat(value.substr(F.lit(1), F.lit(1)), digits.substr(F.lit(1), n - 2))
    luhn = _luhn_digit(value.substr(F.lit(1), n - 1)) == value.substr(n, F.lit(1))
    suffix = F.regexp_extract(value, "(?:ова|ева|ина|ая|ов|ев|ин|ий)$", 0)
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    tld = F.regexp_extract(value, r"\.[^.]+$", 0)

    def name(script: dict[str, str], end: Column) -> Column:
        return F.concat(_syllables(digest, script, 3), F.when(attempt > 0, _syllables(digest.substr(F.lit(20), F.lit(40)), script, 4)).otherwise(""), end)

    given = lambda script: name(script, F.when(kind == "given_f", script["f"]).when(kind == "given_m", script["m"]).otherwise(script["u"]))
    return (
        F.when(kind == "local", F.concat(_shaped(value, stream), more))
        .when(kind == "domain", F.concat(more, _shaped(value, stream, tld)))
        .when(kind == "phone", F.concat(F.translate(digits.substr(F.lit(1), F.lit(1)), "01", "46"), digits.substr(F.lit(2), n - 1)))
        .when(kind == "ssn", F.concat(F.translate(digits.substr(F.lit(1), F.lit(1)), "0789", "1234"), digits.substr(F.lit(2), n - 1)))
        .when(kind == "ip", F.concat_ws(".", octet(1, 1, 223), octet(5, 0, 256), octet(9, 0, 256), octet(13, 1, 254)))
        .when(kind == "card", F.concat(body, F.when(luhn, _luhn_digit(body)).otherwise(digits.substr(n, F.lit(1)))))
        .when(kind == "key", F.concat(F.lit("AKIA"), F.translate(F.upper(digest.substr(F.lit(1), F.lit(16))), "0189", "XYZW")))
        .when(kind == "secret", F.concat(_shaped(value, stream), more))
        .when(kind == "surname", F.when(cyrillic, name(CYRILLIC, suffix)).otherwise(name(LATIN, F.lit(""))))
        .otherwise(F.when(cyrillic, given(CYRILLIC)).otherwise(given(LATIN)))
    )


def assign(parts: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct ``parts`` (kind, value): surrogates of a kind are distinct
    and none is a real value of its kind. Parts that lose a collision try again."""
    real = parts.select("kind", F.col("value").alias("made"))
    todo, done, attempt = parts, None, 0
    while True:
        tried = todo.select("kind", "value", surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key).alias("made"), F.lit(attempt).alias("attempt"))
        tried = materialize(tried if done is None else done.unionByName(tried), "surrogates")
        free = tried.join(real, ["kind", "made"], "left_anti")
        placed = free.withColumn("place", F.row_number().over(W.partitionBy("kind", "made").orderBy("attempt", "value"))).where("place = 1").drop("place")
        after = materialize(placed, "surrogates")
        drop(done)
        done = after
        todo = materialize(parts.join(done, ["kind", "value"], "left_anti"), "collisions")
        drop(tried)
        if todo.isEmpty():
            return done.select("kind", "value", F.col("made").alias("surrogate"))
        attempt += 1


def _digits_into(mention: Column, digits: Column) -> Column:
    """The last digits of ``mention`` replaced by ``digits``, its punctuation kept."""
    n, have = F.length(digits), F.length(F.regexp_replace(mention, "[^0-9]", ""))

    def one(i: Column) -> Column:
        c = mention.substr(i, F.lit(1))
        nth = F.length(F.regexp_replace(mention.substr(F.lit(1), i), "[^0-9]", "")) - (have - n)
        return F.when(c.rlike("[0-9]") & (nth > 0), digits.substr(nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), one), "")


def _written(kind: Column, mention: Column, made: Column) -> Column:
    """A mention with its parts' surrogates ``made``, in the form of the mention."""
    one = made[0]
    title = F.regexp_extract(mention, rf"^(?:{_any(TITLES)})\.? ", 0)
    person = F.concat(title, F.array_join(F.transform(made, lambda x: F.concat(F.upper(x.substr(F.lit(1), F.lit(1))), x.substr(F.lit(2), F.length(x)))), " "))
    return (
        F.when(kind == "email", F.concat(one, F.lit("@"), made[1]))
        .when(kind.isin("phone", "ssn", "card"), _digits_into(mention, one))
        .when(kind == "secret", F.concat(F.regexp_extract(mention, LABEL, 0), one))
        .when(kind == "name", F.when(F.regexp_replace(mention, rf"^(?:{_any(TITLES)})\.? ", "") == F.upper(F.regexp_replace(mention, rf"^(?:{_any(TITLES)})\.? ", "")), F.concat(title, F.upper(F.array_join(made, " ")))).otherwise(person))
        .otherwise(one)
    )


def replace_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", secret: str = "surrogates") -> DataFrame:
    """``docs`` with every mention in ``text`` replaced, and n_mentions, their number.

    ``secret`` keys the surrogates; the same texts and secret give the same result. Edge cases: null
    and empty texts stay as they are with 0 mentions; null ids and repeated rows are kept, equal texts
    get equal results; other columns pass unchanged, one named n_mentions is replaced; an empty frame
    gives an empty frame. Texts without mentions are never shuffled; a mention that fills a third
    of the corpus is one row of the table of mentions.
    """
    base = without(docs, "n_mentions", "_id", "_key", "_made", "_found").withColumn(text, F.col(text).cast("string"))
    base = base.withColumns({"_id": F.col(key).cast("string"), "_key": F.xxhash64(F.col(text), F.length(text)), "_found": F.coalesce(mentions(F.col(text)), F.array().cast("array<string>"))})
    base = materialize(base, "mentions")  # the pattern runs over every text once
    held = base.where(F.size("_found") > 0).select("_id", "_key", F.col("_found").alias("found"))
    said = held.select(F.explode("found").alias("mention")).distinct().withColumn("kind", kind_of(F.col("mention")))
    said = materialize(said.withColumn("parts", parts_of(F.col("kind"), F.col("mention"))), "mentions")
    table = assign(materialize(said.select(F.explode("parts").alias("p")).select("p.kind", "p.value").distinct(), "parts"), secret)
    each = said.select("mention", F.col("kind").alias("whole"), F.posexplode("parts").alias("nth", "p")).select("mention", "whole", "nth", "p.kind", "p.value")
    made = each.join(table, ["kind", "value"]).groupBy("mention", "whole").agg(F.array_sort(F.collect_list(F.struct("nth", "surrogate"))).alias("made"))
    made = made.select("mention", _written(F.col("whole"), F.col("mention"), F.transform("made", lambda x: x["surrogate"])).alias("instead"))

    places = held.dropDuplicates(["_id", "_key"]).select("_id", "_key", F.posexplode("found").alias("nth", "mention"))
    done = places.join(made, "mention").groupBy("_id", "_key").agg(F.array_sort(F.collect_list(F.struct("nth", "instead"))).alias("_made"))
    done = done.select(F.col("_id").alias("_did"), F.col("_key").alias("_dkey"), F.transform("_made", lambda x: x["instead"]).alias("_made"))

    plain = base.where(F.size("_found") == 0).withColumn("n_mentions", F.lit(0).cast("long")).drop("_id", "_key", "_found")
    rich = base.where(F.size("_found") > 0).join(done, F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_key") == F.col("_dkey"))).drop("_id", "_key", "_found")
    pieces = F.split(F.col(text), PATTERN, -1)
    filled = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size("_made")), F.col("_made"), lambda a, b: F.concat(a, b)), ""), F.element_at(pieces, -1))
    rich = rich.withColumns({"n_mentions": F.size("_made").cast("long"), text: filled}).drop("_made", "_did", "_dkey")
    return plain.unionByName(rich)
