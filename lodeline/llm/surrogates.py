"""Personal data replaced by keyed surrogates, in DataFrame operations alone.

Mentions are found by patterns: e-mail addresses, IP addresses, payment cards,
social security and phone numbers, and names after a title. Each entity (a kind
and the mention in canonical form) gets one surrogate wherever it is mentioned;
a person's given name and family name are entities of their own, so that a full
name and the family name alone, or two members of a family, go on belonging together. A surrogate is
made from an HMAC-like hash with the key, and rendered in the form of each
mention: digits keep their places and separators, letters their case and script,
names the gender of their title, cards the validity of their check digit.

Distinct entities keep distinct surrogates. All entities of the corpus are
gathered, their surrogates are counted, and an entity whose surrogate is that of
a smaller one, or is itself an entity, takes the next attempt of the hash until
none collides. Attempts above zero are the exception; only they are joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lodeline.llm.arrow import free, materialise

#: The kinds with their patterns, the first that fits at a place wins. Boundaries keep matches out of longer words and numbers.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}"),
    ("ip", r"(?<![0-9A-Za-z.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9A-Za-z]|\.[0-9])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{8,14}(?![0-9A-Za-z])"),
    ("person", r"(?<![\p{L}])(?:Mr|Mrs|Ms|Miss|Mme|Mlle|Herr|Frau|Señor|Señora|г-н|г-жа)\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?"),
)
#: Titles that tell a gender.
FEMALE = "^(Mrs|Ms|Miss|Mme|Mlle|Frau|Señora|г-жа)\\.? "
#: Given names and family names for surrogates, by gender and script.
NAMES = {
    ("f", "latin"): "Ada Alma Anna Bella Clara Cora Dora Edith Ella Emma Eva Flora Greta Hanna Ida Iris Jana Julia Klara Lena Lina Lucia Mara Maria Mina Nadia Nina Nora Olga Paula Rita Rosa Sara Sonia Stella Tina Uma Vera Wanda Zoe",
    ("m", "latin"): "Adam Albert Anton Ben Carl Cyril David Dirk Edgar Emil Erik Felix Frank Georg Hugo Igor Ivan Jakob Jan Jonas Karl Kurt Leo Lukas Marc Max Milan Nils Oscar Otto Paul Peter Ralf Rene Samuel Simon Theo Tom Viktor Walter",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Ева Елена Зоя Инна Ирина Лидия Мария Нина Ольга Раиса София Тамара",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Игорь Кирилл Лев Максим Олег Павел Роман Сергей Юрий",
    ("f", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Ζωή Θεοδώρα Ιωάννα Κατερίνα Μαρία Νίκη Παρασκευή Σοφία Χριστίνα",
    ("m", "greek"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λεωνίδας Μιχάλης Νίκος Παύλος Πέτρος Σπύρος Στέφανος Χρήστος",
    ("n", "latin"): "Abel Bauer Blanc Borg Castel Conti Dahl Dorn Duran Egger Falk Ferro Frey Gallo Haas Holm Jansen Keller Lang Leroy Lind Marek Meier Molina Moreau Nagel Novak Olsen Perrin Petit Pohl Rossi Roux Sander Silva Stark Steiner Torres Vidal Wolff",
    ("n", "cyrillic"): "Белов Волков Громов Зимин Котов Лебедев Морозов Орлов Петров Седов Титов Фролов",
    ("n", "greek"): "Αθανασίου Αντωνίου Βασιλείου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Οικονόμου Παναγιώτου Στεφάνου Χριστοδούλου",
}
#: Endings of Cyrillic family names, a man's and a woman's; the Greek ones of the lists serve both.
ENDINGS = (("(ов|ев|ёв|ин|ын)", "", "а"), ("(ск|цк)", "ий", "ая"))
#: Overrides that are broadcast; more are joined by a shuffle on the hash of the text.
BROADCAST_ROWS = 20_000
ROUNDS = 40
#: From this attempt on each adds to names and hosts.
GROWS = 14


#: All kinds in one pattern; the card's group is the only one, so that its back reference holds.
PATTERN = "|".join(p for _, p in PATTERNS)
_DIGITS, _NOT_DIGITS = "[0-9]", "[^0-9]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written and computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body).getItem(0)


def kind_of(mention: Column) -> Column:
    """The kind of a mention that PATTERN found."""
    digits = F.length(F.regexp_replace(mention, _NOT_DIGITS, ""))
    return (
        F.when(F.contains(mention, F.lit("@")), "email")
        .when(mention.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(mention.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(mention.rlike(r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), "card")
        .when(digits > 0, "phone")
        .otherwise("person")
    )


def canonical(mention: Column, kind: Column | None = None) -> Column:
    """What mentions of one entity have in common: lower case for e-mail, digits alone for numbers, the names without the title for persons."""
    kind = kind_of(mention) if kind is None else kind
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "ip", mention)
        .when(kind == "person", F.lower(F.regexp_replace(mention, r"^\S+ ", "")))
        .otherwise(F.regexp_replace(mention, _NOT_DIGITS, ""))
    )


def gendered(family: Column, female: bool) -> Column:
    """A Cyrillic family name, or each part of a compound one, in the form for a woman or for a man; other names as they are."""
    for stem, man, woman in ENDINGS:
        old, new = (man, woman) if female else (woman, man)
        family = F.regexp_replace(family, f"{stem}{old}(?=-|$)", f"$1{new}")
    return family


def parts(mention: Column) -> Column:
    """The entities (kind, canon) of a mention: of a person the family name and, if there are two names, the gender and the given name; of all else one.

    A woman's family name is the same entity as a man's in its other form.
    """
    one = lambda kind, canon: F.struct(kind.alias("kind"), canon.alias("canon"))
    gender = F.when(mention.rlike(FEMALE), "f ").otherwise("m ")

    def of(held: Column) -> Column:
        kind, canon = held["kind"], held["canon"]
        name = F.substring_index(canon, " ", -1)
        family = one(F.lit("family"), F.when(mention.rlike(FEMALE), gendered(name, False)).otherwise(name))
        given = one(F.lit("given"), F.concat(gender, F.substring_index(canon, " ", 1)))
        return F.when(kind != "person", F.array(one(kind, canon))).when(F.contains(canon, F.lit(" ")), F.array(family, given)).otherwise(F.array(family))

    return let(kind_of(mention), lambda kind: let(one(kind, canonical(mention, kind)), of))


def _hash(kind: Column, canon: Column, attempt: Column, key: str, part: str = "") -> Column:
    once = F.sha2(F.concat_ws("|", F.lit(key + part), kind, canon, attempt.cast("string")), 256)
    return F.sha2(F.concat(F.lit(key), once), 256)


def _number(h: Column, i: int, below: int) -> Column:
    """A number below ``below`` from the i-th seven hex digits of a hash."""
    return (F.conv(F.substring(h, 1 + 7 * i, 7), 16, 10).cast("bigint") % below).cast("int")


def _draw(h: Column, digits: int) -> Column:
    """So many decimal digits, 15 from each 14 hex digits of the hash and its own hash."""
    parts = []
    for i in range(-(-digits // 15)):
        source = h if i < 4 else F.sha2(h, 256)
        parts.append(F.lpad((F.conv(F.substring(source, 1 + 14 * (i % 4), 14), 16, 10).cast("bigint") % 10**15).cast("string"), 15, "0"))
    return F.substring(F.concat(*parts), 1, digits)


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits of even length."""
    one = lambda held, i: F.substr(held, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
    return let(digits, lambda held: F.aggregate(F.sequence(F.lit(1), F.length(held)), F.lit(0), lambda total, i: total + one(held, i) - F.when(one(held, i) > 9, 9).otherwise(0)) % 10)


def _names(gender: Column, script: Column) -> Column:
    """The list of names for the gender and the script."""
    out = None
    for (g, s), names in NAMES.items():
        here, held = (gender == g) & (script == s), F.split(F.lit(names), " ")
        out = F.when(here, held) if out is None else out.when(here, held)
    return out


def _pick(h: Column, i: int, names: Column) -> Column:
    """A name of a list, chosen by the i-th part of a hash."""
    return F.element_at(names, (F.conv(F.substring(h, 1 + 7 * i, 7), 16, 10).cast("bigint") % F.size(names)).cast("int") + 1)


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of an entity's surrogate.

    E-mail: letters and digits of the local part replaced one for one, then a
    host of the reserved example domains. IP: four octets from 1 to 254. Card:
    the first digit stays, and the check digit is right exactly if it was.
    Phone: the digits before the last ten, or the first if there are no more,
    stay. Names: of the lists for the script and, if given names, the gender.
    Beyond GROWS attempts every further one adds a name, or a digit of the
    host, so names and addresses don't run out.
    """
    held = F.struct(kind.alias("kind"), canon.alias("canon"), attempt.alias("attempt"))
    hashed = lambda e: F.struct(e["kind"].alias("kind"), e["canon"].alias("canon"), e["attempt"].alias("attempt"), _hash(e["kind"], e["canon"], e["attempt"], key).alias("h"))
    return let(held, lambda e: let(hashed(e), lambda x: _surrogate(x["kind"], x["canon"], x["attempt"], x["h"])))


def _surrogate(kind: Column, canon: Column, attempt: Column, h: Column) -> Column:
    local = F.substring_index(canon, "@", 1)
    letter = lambda i, alphabet, span: F.substr(F.lit(alphabet), (F.conv(F.substr(h, (i * 3) % 61 + 1, F.lit(4)), 16, 10).cast("int") + i * 7) % span + 1, F.lit(1))
    changed = F.array_join(
        F.transform(
            F.split(local, ""),
            lambda c, i: F.when(c.rlike("[a-z]"), letter(i, "abcdefghijklmnopqrstuvwxyz", 26)).when(c.rlike("[0-9]"), letter(i, "0123456789", 10)).otherwise(c),
        ),
        "",
    )
    host = F.concat(F.lit("@mail"), _number(h, 8, 1000).cast("string"), F.when(attempt > GROWS, F.substr(F.sha2(h, 256), F.lit(1), F.least(attempt - GROWS, F.lit(48)))).otherwise(""), F.lit(".example."), F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), _number(h, 7, 3) + 1))
    ip = F.concat_ws(".", *[(_number(h, i, 254) + 1).cast("string") for i in range(4)])
    body = F.concat(F.substring(canon, 1, 1), _draw(h, 14))
    right = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    check = F.when(_luhn(canon) == 0, right).otherwise((right + 1 + _number(h, 8, 9)) % 10)
    kept = F.when(F.length(canon) > 10, F.length(canon) - 10).otherwise(F.lit(1))
    phone = F.concat(F.substr(canon, F.lit(1), kept), F.substr(_draw(h, 30), F.lit(1), F.length(canon) - kept))
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    role = F.when(kind == "family", "n").otherwise(F.substring(canon, 1, 1))
    nothing = F.lit("")

    def compound(names: Column) -> Column:
        # later attempts compound names, so the supply doesn't run out; each part is written once, so that the plan stays small
        more = lambda i: F.concat(F.lit("-"), _pick(F.sha2(F.concat(h, i.cast("string")), 256), 0, names))
        return F.concat(
            F.when(kind == "given", F.substring(canon, 1, 2)).otherwise(nothing),
            _pick(h, 1, names),
            F.when(attempt > 3, F.concat(F.lit("-"), _pick(h, 2, names))).otherwise(nothing),
            F.when(attempt > 12, F.concat(F.lit("-"), _pick(h, 4, names))).otherwise(nothing),
            F.when(attempt > GROWS, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt - GROWS, F.lit(1))), more), "")).otherwise(nothing),
        )

    name = F.lower(let(_names(role, script), compound))
    return (
        F.when(kind == "email", F.concat(changed, host))
        .when(kind == "ip", ip)
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "ssn", _draw(h, 9))
        .when(kind == "phone", phone)
        .otherwise(name)
    )


def render(mention: Column, replaced: Column, kind: Column | None = None) -> Column:
    """A surrogate's canonical form in the format of a mention: its separators, title, and upper case if the mention is."""
    kind = kind_of(mention) if kind is None else kind
    at = F.sequence(F.lit(1), F.length(mention))
    place = lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), _NOT_DIGITS, ""))
    numbers = F.array_join(
        F.transform(at, lambda i: F.when(F.substr(mention, i, F.lit(1)).rlike(_DIGITS), F.substr(replaced, place(i), F.lit(1))).otherwise(F.substr(mention, i, F.lit(1)))), ""
    )
    # every part of a compound name begins with a capital
    raised = F.replace(F.initcap(F.replace(replaced, F.lit("-"), F.lit("- "))), F.lit("- "), F.lit("-"))
    titled = F.concat(F.regexp_extract(mention, r"^\S+ ", 0), raised)
    # letters before the @ have the case of those they stand for
    letters = lambda t: F.split(F.substring_index(t, "@", 1), "")
    cased = F.array_join(F.zip_with(letters(mention), letters(replaced), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")
    shouted = mention.rlike(r"\p{Lu}") & ~mention.rlike(r"\p{Ll}")
    return (
        F.when(kind == "email", F.when(shouted, F.upper(replaced)).otherwise(F.concat(cased, F.lit("@"), F.substring_index(replaced, "@", -1))))
        .when(kind == "ip", replaced)
        .when(kind == "person", F.when(F.regexp_replace(mention, r"^\S+ ", "").rlike(r"^[^\p{Ll}]+$"), F.concat(F.regexp_extract(mention, r"^\S+ ", 0), F.upper(replaced))).otherwise(titled))
        .otherwise(numbers)
    )


def mentions(text: Column) -> Column:
    """All mentions in a text in order; none if it is null. Texts without a digit, an @ or a title are not searched further."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(r"[0-9@]|(?:Mr|Mrs|Ms|Miss|Mme|Mlle|Herr|Frau|Señor|Señora|г-н|г-жа)\.? \p{Lu}"), found).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, canon): the distinct entities of all texts."""
    one = docs.select(F.explode(mentions(F.col(text_col))).alias("m")).groupBy("m").agg(F.lit(1).alias("x"))
    return one.select(F.explode(parts(F.col("m"))).alias("e")).select("e.kind", "e.canon").distinct()


def attempts(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities that can't have their first surrogate, so that all surrogates differ and none is an entity.

    Names and addresses always settle, since their surrogates grow with the
    attempts. RuntimeError if ROUNDS rounds don't settle numbers, whose surrogates
    have their length: when a corpus has nearly all numbers of one form.
    """
    placed = materialise(found.withColumn("attempt", F.lit(0)))
    for _ in range(ROUNDS):
        made = placed.withColumn("s", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        # the entity with the fewest attempts keeps a surrogate that several have
        first = made.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canon")).alias("first"))
        taken = placed.select("kind", F.col("canon").alias("s"), F.lit(True).alias("taken"))
        judged = made.join(first, ["kind", "s"]).join(taken, ["kind", "s"], "left")
        ok = F.col("taken").isNull() & (F.col("first.canon") == F.col("canon"))
        judged = materialise(judged.select("kind", "canon", "attempt", ok.alias("ok")))
        if judged.where("not ok").isEmpty():
            return placed.where("attempt > 0")
        placed = judged.select("kind", "canon", F.when(F.col("ok"), F.col("attempt")).otherwise(F.col("attempt") + 1).alias("attempt"))
    raise RuntimeError("surrogates did not become distinct")


def _replace(text: Column, found: Column, overrides: Column | None, key: str) -> Column:
    """The text with its mentions replaced; ``overrides`` maps kind|canon to an attempt."""

    def attempt(e: Column) -> Column:
        return F.lit(0) if overrides is None else F.coalesce(F.element_at(overrides, F.concat_ws("|", e["kind"], e["canon"])), F.lit(0))

    def one(m: Column) -> Column:
        made = lambda e: F.struct(e["kind"].alias("kind"), surrogate(e["kind"], e["canon"], attempt(e), key).alias("s"))
        # a given name comes with its gender and stands before the family name
        named = lambda found: F.when((found[0]["kind"] == "family") & m.rlike(FEMALE), gendered(found[0]["s"], True)).otherwise(found[0]["s"])
        whole = lambda found: F.when(F.size(found) > 1, F.concat(F.substring(found[1]["s"], 3, 1 << 20), F.lit(" "), named(found))).otherwise(named(found))
        kind = lambda found: F.when(found[0]["kind"] == "family", "person").otherwise(found[0]["kind"])
        joined = lambda found: F.struct(whole(found).alias("s"), kind(found).alias("kind"))
        return let(F.transform(parts(m), made), lambda found: let(joined(found), lambda g: render(m, g["s"], g["kind"])))

    between = F.split(text, PATTERN, -1)
    joined = F.array_join(F.transform(F.arrays_zip(between.alias("b"), F.transform(found, one).alias("s")), lambda x: F.concat(x["b"], F.coalesce(x["s"], F.lit("")))), "")
    return F.when(F.size(found) > 0, joined).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced and a column n_replaced, the number of mentions; all else stays.

    ``key`` is a secret: whoever has it can find the original of a number by
    trial. Null texts stay null and empty ones empty, with n_replaced 0. Equal
    rows are treated alike, whatever their number and length, an empty table
    stays empty, and a column n_replaced that the input has is replaced. The same
    key gives the same surrogates for the same corpus.
    """
    if not key:
        raise ValueError("surrogates need a key")
    moved = attempts(entities(docs, text_col), key)
    columns = [c for c in docs.columns if c != "n_replaced"]
    held, hashed, own_moves = (free(x, docs) for x in ("found", "hash", "moved"))
    text, found = F.col(text_col), F.col(held)
    base = docs.drop("n_replaced").withColumn(held, mentions(text))
    final = lambda df, overrides: df.select(*[_replace(text, found, overrides, key).alias(c) if c == text_col else F.col(c) for c in columns], F.size(found).cast("bigint").alias("n_replaced"))
    count = moved.count()
    if not count:
        return final(base.withColumn(held, F.coalesce(found, F.array().cast("array<string>"))), None)
    moved = moved.select(F.concat_ws("|", "kind", "canon").alias("entity"), "attempt")
    named = F.array_distinct(F.flatten(F.transform(F.col("f"), lambda m: F.transform(parts(m), lambda e: F.concat_ws("|", e["kind"], e["canon"])))))
    met = docs.select(text.alias("t"), mentions(text).alias("f")).where(F.size("f") > 0).select(F.xxhash64("t").alias(hashed), F.explode(named).alias("entity"))
    own = met.join(F.broadcast(moved) if count <= BROADCAST_ROWS else moved, "entity").groupBy(hashed).agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias(own_moves))
    own = materialise(own)
    joined = base.withColumn(hashed, F.xxhash64(text)).join(F.broadcast(own) if own.count() <= BROADCAST_ROWS else own, hashed, "left")
    return final(joined, F.col(own_moves))
