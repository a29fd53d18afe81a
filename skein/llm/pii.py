"""PII surrogates in DataFrame operations only.

One regular expression finds entities of eight kinds. Each distinct entity is taken apart into the parts that
must stay the same wherever they stand: a person's given name and surname, a mail address' domain and local
part, and for the other kinds the whole without separators. Each part gets a replacement drawn from a keyed
hash: digits for digits, letters for letters of the same script and case, valid octets, a card number that
passes its check digit if the original does, hexadecimal for hexadecimal, names built of syllables that fit the
script and, for given names, the gender. A given name's gender is what the titles beside it say anywhere
in the table; where they disagree or say nothing it stays neutral. "Dr. Anna Weber", "Frau Anna Weber" and "Frau Weber"
thus share their names' replacements.

Within a text, every further mention of a titled person's full name or surname, without a title, gets the same
replacement; such mentions are not counted as entities.

A table of all distinct parts checks that no two of one kind get the same replacement and that none becomes an
existing one; those that clash, and only those, draw again, names and domains from a pool that grows with the draws.
Equal entities thus stay equal everywhere and different ones different, and separators, capitals, titles and
country codes stay in place.

Defined cases: null texts stay null and empty ones empty; texts without entities are unchanged; repeated
rows get equal texts; extra columns and names that clash with the helpers' are kept; an empty table gives
no rows. Where a format has no room for as many distinct forms, the last ones end in hash letters:
distinctness before format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import materialize, unique_names

EDGE, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
MALE = "Mr|Mister|Sir|Herr|Señor|Sr|Don|Monsieur|Господин|Г-н|Κύριος"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Señora|Señorita|Sra|Doña|Madame|Mme|Mlle|Госпожа|Г-жа|Κυρία"
NEUTRAL = "Dr|Prof"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Kinds in the order of precedence; at one place the first that matches counts.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?<=(?i:token|secret|password|passwd|api[_-]?key) {0,2}[=:] {0,2}[\"'])[^\"'\s]{8,}|" + EDGE + r"(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|[0-9a-f]{32,}+|[0-9A-F]{32,}+)" + END,
    "iban": EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + END,
    "ip": r"(?<![\p{L}\d.])(?:" + OCTET + r"\.){3}" + OCTET + r"(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<!\d)\+?\d{0,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "person": EDGE + rf"(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity.
HINT = rf"[@0-9]|AKIA|ghp_|[0-9a-f]{{32}}|[0-9A-F]{{32}}|{EDGE}(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}}|(?i:token|secret|password|passwd|api[_-]?key) {{0,2}}[=:]"

#: First given names by script and gender, endings of built ones, and syllables of names by script: any such lists would do.
GIVEN = {
    ("Latin", "m"): "Albert Bruno Carl David Edgar Felix Georg Hugo Ivan Jonas Karl Leon Martin Nico Oscar Paul Robert Simon Thomas Victor",
    ("Latin", "f"): "Alice Bertha Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Marta Nora Olga Paula Rosa Sofia Teresa Vera",
    ("Latin", "n"): "Alex Ariel Charlie Dana Eden Francis Gabriel Jamie Jordan Kim Lee Morgan Noel Quinn Robin Sam Sasha Taylor Toni Val",
    ("Cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим",
    ("Cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лариса Мария",
    ("Cyrillic", "n"): "Саша Женя Валя Слава Шура Тоня Паша Вика Лера Мика",
    ("Greek", "m"): "Άρης Γιώργος Δημήτρης Ηλίας Θάνος Ιάσων Κώστας Λουκάς Μάρκος Νίκος",
    ("Greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Θάλεια Ιωάννα Κατερίνα Μαρία",
    ("Greek", "n"): "Χαρά Φώτης Τόνια Σάκης Ρένα Πόπη Ορέστης Νέλλη Μίμης Λίνα",
}
ENDINGS = {("Latin", "m"): "o", ("Latin", "f"): "a", ("Latin", "n"): "i", ("Cyrillic", "m"): "слав", ("Cyrillic", "f"): "на", ("Cyrillic", "n"): "я", ("Greek", "m"): "ος", ("Greek", "f"): "α", ("Greek", "n"): "ι"}
SYLLABLES = {"Latin": "ba ben cor dal dre fel gar han kel lam lor mar mon nel or pas ran sel tor ven wal wen zan zor", "Cyrillic": "бар бел вол гор дан зор кал лен мар нов пет рам сол тар", "Greek": "βα γα δου κα λα μα νο πα ρα σα τα φο"}
TAILS = {"Latin": "berg dorf field ford ley man mont son stein ton well wood", "Cyrillic": "енко ич овский юк", "Greek": "ίδης άκης όπουλος"}
LETTERS = {r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя", r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", r"[à-öø-ÿ]": "àáâãäåæçèéêëìíîïñòóôõöøùúûüý"}


def kind_of(entity: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        # look-behinds see what comes before the entity; alone, only its own form counts
        whole = entity.rlike(f"^(?:{pattern})$") if kind != "secret" else entity.rlike(rf"^(?:[^\"'\s]{{8,}})$") & ~entity.rlike(rf"^(?:{PATTERNS['ip']}|{PATTERNS['card']}|{PATTERNS['ssn']}|{PATTERNS['iban']})$")
        out = F.when(whole, kind) if out is None else out.when(whole, kind)
    return out.otherwise("secret")


def name_part(entity: Column) -> Column:
    return F.regexp_replace(entity, rf"^(?:{MALE}|{FEMALE}|{NEUTRAL})\.? ", "")


def _title_gender(entity: Column) -> Column:
    return F.when(entity.rlike(rf"^(?:{MALE})\.? "), "m").when(entity.rlike(rf"^(?:{FEMALE})\.? "), "f")


def parts_of(kind: Column, entity: Column) -> Column:
    """An entity's parts (kind, space, form, hint): forms of one kind and space must stay distinct.

    ``hint`` is a title's gender. Letter case is set aside in mail addresses and names, separators elsewhere.
    """
    part = lambda k, space, form, hint=None: F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), space.alias("space"), form.alias("form"), (hint if hint is not None else F.lit(None).cast("string")).alias("hint"))
    none, low = F.lit(""), F.lower(entity)
    domain = F.substring_index(low, "@", -1)
    name = F.lower(name_part(entity))
    surname, given = part("surname", none, F.substring_index(name, " ", -1)), part("given", none, F.substring_index(name, " ", 1), _title_gender(entity))
    whole = F.when(kind.isin("ip", "secret"), entity).otherwise(F.regexp_replace(entity, r"[^\p{L}\p{N}]", ""))
    return (
        F.when(kind == "email", F.array(part("domain", none, domain), part("local", domain, F.substring_index(low, "@", 1))))
        .when(kind == "person", F.when(name.contains(" "), F.array(surname, given)).otherwise(F.array(surname)))
        .otherwise(F.array(part(kind, none, whole)))
    )


def _stream(key: str, kind: Column, form: Column, draw: Column) -> Column:
    """256 hexadecimal digits from the keyed hash."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(f"{key}/{i}"), kind, draw.cast("string"), form), 256) for i in range(4)])


def _number(stream: Column, i: Column, digits: int = 4) -> Column:
    return F.conv(F.substring(stream, i % 250 + 1, F.lit(digits)), 16, 10).cast("int")


def _pick(words: str, n: Column) -> Column:
    array = F.array(*[F.lit(w) for w in words.split()])
    return F.element_at(array, (n % len(words.split()) + 1).cast("int"))


def _like(form: Column, stream: Column, hexadecimal: Column | None = None) -> Column:
    """Each letter and digit replaced by another of its class."""

    def one(i: Column) -> Column:
        c, n = F.substring(form, i, F.lit(1)), _number(stream, i * 3)
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), n % 26 + 1, F.lit(1))
        if hexadecimal is not None:
            letter = F.when(hexadecimal, F.substring(F.lit("abcdef"), n % 6 + 1, F.lit(1))).otherwise(letter)
        out = F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter))
        for script, letters in LETTERS.items():
            other = F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
            out = out.when(F.lower(c).rlike(script), F.when(c.rlike(r"\p{Lu}"), F.upper(other)).otherwise(other))
        return out.otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits."""
    n = F.length(digits)
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + F.when(x > 9, x - 9).otherwise(x))


def _card(form: Column, stream: Column) -> Column:
    drawn = F.concat(F.substring(form, 1, 1), _like(F.substring(form, 2, 100), stream))
    head = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = (10 - _luhn(F.concat(head, F.lit("0"))) % 10) % 10
    return F.when(_luhn(form) % 10 == 0, F.concat(head, check.cast("string"))).otherwise(drawn)


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(name.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")


def _syllables(script: str, stream: Column, count: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: _pick(SYLLABLES[script], _number(stream, i * 7 + 20))), "")


def _name(form: Column, stream: Column, attempt: Column, gender: Column | None = None) -> Column:
    """A surname, or for a gender a given name, in lower case; later attempts have more syllables."""
    script, out = _script(form), None
    for s in SYLLABLES:
        if gender is None:
            made = F.concat(_syllables(s, stream, F.floor(attempt / 2).cast("int") + 2), _pick(TAILS[s], _number(stream, F.lit(9))))
        else:
            made = None
            for g in "mfn":
                built = F.concat(_syllables(s, stream, F.floor(attempt / 2).cast("int") + 1), F.lit(ENDINGS[s, g]))
                own = F.when(attempt < 2, F.lower(_pick(GIVEN[s, g], _number(stream, F.lit(1))))).otherwise(built)
                made = F.when(gender == g, own) if made is None else made.when(gender == g, own)
        out = F.when(script == s, made) if out is None else out.when(script == s, made)
    return out


def _domain(form: Column, stream: Column, attempt: Column) -> Column:
    """As many labels as before, the last one ``example``."""
    above = F.regexp_replace(form, r"(?:^|\.)[^.]+\.[^.]+$", "")
    host = F.concat(F.lit("h"), _syllables("Latin", stream, F.floor(attempt / 2).cast("int") + 2), F.lit(".example"))
    return F.when(above == "", host).otherwise(F.concat(_like(above, stream), F.lit("."), host))


def draw(kind: Column, form: Column, gender: Column, attempt: Column, key: str, draws: int) -> Column:
    """A part's replacement."""
    s = _stream(key, kind, form, attempt)
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_number(s, i * 5) % 254 + 1).cast("string")), ".")
    letters = F.translate(s, "0123456789", "ghijklmnop")
    longer = F.when(attempt < 8, "").otherwise(F.substring(letters, F.lit(1), F.floor(attempt / 8).cast("int")))
    out = (
        F.when(kind == "domain", _domain(form, s, attempt))
        .when(kind == "local", F.concat(_like(form, s), longer))
        .when(kind == "given", _name(form, s, attempt, gender))
        .when(kind == "surname", _name(form, s, attempt))
        .when(kind == "ip", octets)
        .when(kind == "card", _card(form, s))
        .when(kind == "iban", F.concat(F.substring(form, 1, 2), _like(F.substring(form, 3, 100), s)))
        .otherwise(_like(form, s, form.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")))
    )
    return F.when(attempt < draws, out).otherwise(F.concat(out, F.lit("x"), F.substring(letters, 1, 16)))


def pour(kind: Column, entity: Column, new: Column) -> Column:
    """The replacement of an entity's parts (a map by their kind) in its own shape: separators, capitals, title, country code."""
    form = new[kind]

    def one(i: Column) -> Column:
        c = F.substring(entity, i, F.lit(1))
        at = F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(form, at, F.lit(1))).otherwise(c)

    shaped = F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), one), "")
    longer = F.substring(form, F.length(F.regexp_replace(entity, r"[^\p{L}\p{N}]", "")) + 1, F.lit(1000))
    code = F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .(-])", 0)
    capitals = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    address, name = F.concat(new["local"], F.lit("@"), new["domain"]), name_part(entity)
    person = F.initcap(F.concat_ws(" ", new["given"], new["surname"]))
    return (
        F.when(kind == "email", F.when(capitals(entity), F.upper(address)).otherwise(address))
        .when(kind.isin("ip", "secret"), form)
        .when(kind == "person", F.concat(F.regexp_extract(entity, rf"^(?:{MALE}|{FEMALE}|{NEUTRAL})\.? ", 0), F.when(capitals(name), F.upper(person)).otherwise(person)))
        .when(kind == "phone", F.concat(code, F.substring(shaped, F.length(code) + 1, F.lit(1000)), longer))
        .otherwise(F.concat(shaped, longer))
    )


def names_of(found: Column) -> Column:
    """From a text's entities (array of structs with entity, replacement, whole): its people's names and surnames with
    their replacements (name, new), the longest first."""
    people = F.filter(found, lambda x: x["whole"] == "person")
    last = lambda name: F.substring_index(name, " ", -1)
    pair = lambda name, new: F.struct((-F.length(name)).alias("order"), name.alias("name"), new.alias("new"))
    both = F.transform(people, lambda x: F.array(*(pair(of(name_part(x["entity"])), of(name_part(x["replacement"]))) for of in (lambda n: n, last))))
    return F.array_sort(F.array_distinct(F.flatten(both)))


def with_names(text: Column, names: Column) -> Column:
    """``text`` with each of the names replaced where it stands as a word of its own."""
    pattern = F.concat(F.lit(f"{EDGE}(?:"), F.array_join(F.transform(names, lambda n: n["name"]), "|"), F.lit(f"){END}(?!-\\p{{L}})"))
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    new = lambda m: F.filter(names, lambda n: n["name"] == m)[0]["new"]
    mixed = F.zip_with(between, found, lambda b, m: F.concat(b, F.when(m.isNull(), "").otherwise(new(m))))
    return F.when((F.size(names) > 0) & F.regexp_like(text, pattern), F.array_join(mixed, "")).otherwise(text)


def resolve(parts: DataFrame, key: str, draws: int = 30) -> DataFrame:
    """From distinct parts (kind, form, and if there are such columns space and gender): kind, space, form, new.

    New forms are distinct within a kind and space and equal no existing form there. Each round draws for the
    parts still open and keeps those whose replacement is free; of equal draws the least form's stays. After
    ``draws`` rounds a part's format has no room left: what is still open then ends in hash letters.
    """
    have = [F.col(c) if c in parts.columns else F.lit(other).alias(c) for c, other in (("space", ""), ("gender", "n"))]
    every = materialize(parts.select("kind", "form", *have), "parts")
    spread = max(every.sparkSession.sparkContext.defaultParallelism, -(-every.count() // 5_000))  # drawing is the dear step
    taken, open_, solved = every.select("kind", "space", F.col("form").alias("new")), every, []
    for attempt in range(draws + 8):
        drawn = open_.repartition(spread, "kind", "space", "form").withColumn("new", draw(F.col("kind"), F.col("form"), F.col("gender"), F.lit(attempt), key, draws))
        drawn = materialize(drawn, "draws")
        place = ["kind", "space", "new"]
        first = drawn.groupBy(*place).agg(F.min("form").alias("form")).join(taken, place, "left_anti")
        good = materialize(first, "drawn")
        solved.append(good)
        open_ = materialize(drawn.drop("new").join(good.select("kind", "space", "form"), ["kind", "space", "form"], "left_anti"), "open")
        if open_.isEmpty():
            out = solved[0]
            for more in solved[1:]:
                out = out.unionByName(more)
            return out.select("kind", "space", "form", "new")
        taken = taken.unionByName(good.select(*place))
    raise RuntimeError("replacements still clash after the last draw")


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities replaced in ``text``, and a count of them in the last column ``n_entities``."""
    rid, ents, parts, text, new, own, names, count = unique_names(docs, "rid", "ents", "parts", "text_kept", "new", "own_rid", "names", "n_entities")
    body = F.col("text").cast("string")
    found = F.when(body.rlike(HINT), F.regexp_extract_all(body, F.lit(ENTITY), F.lit(0)))
    held = docs.withColumn(ents, found).withColumn(parts, F.when(F.size(ents) > 0, F.split(body, ENTITY, -1))).withColumn(rid, F.monotonically_increasing_id())
    held = materialize(held.withColumn("text", F.when(F.coalesce(F.size(ents), F.lit(0)) <= 0, body)), "entities")  # from here row ids are fixed
    some = held.where(F.size(ents) > 0)
    mentions = some.select(F.col(rid).alias("rid"), F.posexplode(ents).alias("pos", "entity"))
    values = mentions.select("entity").distinct().withColumn("whole", kind_of(F.col("entity")))
    values = materialize(values.select("entity", "whole", F.explode(parts_of(F.col("whole"), F.col("entity"))).alias("part")).select("entity", "whole", "part.*"), "values")
    said = lambda g: F.max((F.col("hint") == g).cast("int"))
    sure = lambda a, b: (F.coalesce(said(a), F.lit(0)) == 1) & (F.coalesce(said(b), F.lit(0)) == 0)
    distinct = values.groupBy("kind", "space", "form").agg(F.when(sure("m", "f"), "m").when(sure("f", "m"), "f").otherwise("n").alias("gender"))
    solved = resolve(distinct, key)
    whole = values.join(solved, ["kind", "space", "form"]).groupBy("entity", "whole").agg(F.map_from_entries(F.collect_list(F.struct("kind", "new"))).alias("new"))  # two parts at most
    table = whole.select("entity", "whole", pour(F.col("whole"), F.col("entity"), F.col("new")).alias("replacement"))
    replaced = mentions.join(table, "entity").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "replacement", "entity", "whole"))).alias(new)).withColumnRenamed("rid", own)
    joined = some.join(replaced, F.col(rid) == F.col(own)).withColumn(names, names_of(F.col(new)))
    mixed = F.transform(F.sequence(F.lit(0), F.size(new)), lambda i: F.concat(with_names(F.element_at(F.col(parts), i + 1), F.col(names)), F.when(i < F.size(new), F.try_element_at(F.col(new), i + 1)["replacement"]).otherwise("")))
    done = joined.withColumn(text, F.array_join(mixed, "")).select(*[F.col(text).alias("text") if c == "text" else F.col(c) for c in docs.columns], F.size(new).alias(count))
    rest = held.where(F.coalesce(F.size(ents), F.lit(0)) <= 0).select(*docs.columns, F.lit(0).alias(count))
    return rest.union(done)
