"""Personal data replaced by keyed surrogates of the same kind, with DataFrame functions only.

Detected entities become rows of a corpus-wide table of distinct (kind, canonical value). Each gets a surrogate
from a keyed hash: digits for digits and letters for letters in the same script and case, given names of the same
gender. Surrogates that meet another one or a real value of their kind are drawn again until none do, so different values stay
different and all mentions of one value, however written, get the same surrogate. The words of a document's names are also
replaced where they stand alone in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import shaped
from helixframe.llm.spans import MARK, bound, located, parts, unmarked
from helixframe.session import cut_lineage

#: Titles and common given names by gender.
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Doña|Госпожа|госпожа|Κυρία|κυρία"
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Don|Господин|господин|Κύριος|κύριος"
OTHER_TITLES = "Dr|Prof|Professor|Mx"
FEMALE_NAMES = "Mary|Anna|Maria|María|Emma|Sophie|Laura|Julia|Elena|Lucía|Camille|Claire|Sarah|Susan|Linda|Petra|Мария|Анна|Ольга|Ελένη|Μαρία"
MALE_NAMES = "John|James|Robert|Michael|David|Peter|Hans|Karl|Pierre|Jean|Luis|Carlos|José|Juan|Thomas|Paul|Иван|Сергей|Пётр|Γιώργος|Νίκος"
_WORD = r"\p{Lu}[\p{L}'’-]+"
_TITLE = rf"(?:{FEMALE_TITLES}|{MALE_TITLES}|{OTHER_TITLES})"
#: Kinds in the order in which they are told apart, with what a match of the kind looks like.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{1,4}(?:[\x20.-]?\d{2,4}){1,4}|\(\d{2,4}\)\x20?\d{3,4}[\x20.-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "card": r"(?<![\w-])\d(?:[\x20-]?\d){12,18}(?![\w-])",
    "name": rf"(?<=(?<!\p{{L}}){_TITLE}\.?\x20){_WORD}(?:\x20{_WORD})?|(?<!\p{{L}})(?:{FEMALE_NAMES}|{MALE_NAMES})\x20{_WORD}",
}
#: All of them, tried only where the first character can begin one; and what a text with any of them holds.
ANY = PATTERNS["email"] + "|(?=[\\p{Lu}0-9+(])(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "email") + ")"
_HINT = rf"@|[0-9][0-9.\x20()-]{{6}}|(?=[\p{{Lu}}гκ])(?:[A-Z]{{2}}\d\d|{_TITLE}\.?\x20|{FEMALE_NAMES}|{MALE_NAMES})"
KINDS = [*PATTERNS]
#: Attempts that keep the form of an address, and of other values but names.
EMAIL_ATTEMPTS, SHAPED_ATTEMPTS = 3, 16
#: Syllables of made-up names by script, and the endings of female and male given names.
SYLLABLES = {
    "latin": ("ba be bo da de di fa fe ga ha ja ka ke la le li lo ma me mi mo na ne ni no pa ra re ri ro sa se ta te ti to va ve vi za", "na", "no"),
    "cyrillic": ("ба бе бо да де ди фа га ха ка ке ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се та те ти то ва ве ви за", "на", "ий"),
    "greek": ("βα βε γα γε δα δε ζα θα κα κε λα λε λι λο μα με μι μο να νε νι νο πα ρα ρε ρι ρο σα σε τα τε τι το φα χα", "να", "νος"),
}


def _kind(value: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in KINDS if k != "name"]):
        out = F.when(value.rlike(rf"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _gender(token: Column, gap: Column) -> Column:
    return (F.when(token.rlike(f"^(?:{FEMALE_NAMES})$"), "f").when(token.rlike(f"^(?:{MALE_NAMES})$"), "m")
            .when(gap.rlike(rf"(?<!\p{{L}})(?:{FEMALE_TITLES})\.?\x20$"), "f").when(gap.rlike(rf"(?<!\p{{L}})(?:{MALE_TITLES})\.?\x20$"), "m").otherwise("n"))


def _script(token: Column) -> Column:
    return F.when(token.rlike(r"\p{IsCyrillic}"), "cyrillic").when(token.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def mentions(pieces: Column, givens: Column) -> Column:
    """array<struct<part, token, kind, canon, form, gender>> of the matches at the odd places of `pieces`.

    Names count word by word, so a surname keeps its surrogate with and without a given name: the last word is a surname
    (kind surname:script), one before it a given name (given:script), as is a name of one word that is among `givens`.
    """
    def tokens(k: Column) -> Column:
        value, gap = F.get(pieces, k), F.right(F.get(pieces, k - 1), F.lit(24))  # a title is near the end
        kind = _kind(value)
        words = F.when(kind == "name", F.split(value, " ")).otherwise(F.array(value))

        def one(word: Column, place: Column) -> Column:
            given = F.concat(F.lit("given:"), _script(word))
            named = F.when((place < F.size(words) - 1) | ((F.size(words) == 1) & F.array_contains(givens, word)), given).otherwise(F.concat(F.lit("surname:"), _script(word)))
            canon = (F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(word, r"\D", ""))
                     .when(kind == "iban", F.replace(word, F.lit(" "), F.lit(""))).otherwise(F.lower(word)))
            return F.struct(k.alias("part"), place.alias("token"), F.when(kind == "name", named).otherwise(kind).alias("kind"),
                            canon.alias("canon"), word.alias("form"), _gender(word, gap).alias("gender"))

        return F.transform(words, one)

    at = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(at, tokens))


def _with_bare_names(split: DataFrame) -> DataFrame:
    """Adds `givens`, the words of given names of a row, and to `pieces` the places where words of its names stand alone."""
    m = bound(F.col("pieces"), lambda p: mentions(p, F.array().cast("array<string>")))
    rows = split.withColumn("_m", F.filter(m, lambda x: x["kind"].contains(":")))
    rows = rows.withColumn("givens", F.transform(F.filter("_m", lambda x: x["kind"].startswith("given:")), lambda x: x["form"]))
    words = F.sort_array(F.array_distinct(F.transform("_m", lambda x: x["form"])), asc=False)  # longer ones first
    pattern = F.concat(F.lit(f"({ANY}|(?<!\\p{{L}})(?:"), F.array_join(words, "|"), F.lit(r")(?!\p{L}))"))
    again = F.split(F.regexp_replace(F.col("plain"), pattern, F.lit(f"{MARK}$1{MARK}")), MARK, -1)
    return rows.withColumn("pieces", F.when(F.size("_m") > 0, again).otherwise(F.col("pieces"))).drop("_m")


def _octet(hashed: Column, place: Column) -> Column:
    return F.conv(F.substring(hashed, F.pmod(place, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shape(text: Column, hashed: Column) -> Column:
    """Digits for digits, letters for letters of the same case; all else as it is."""
    def letter(c: Column, k: Column) -> Column:
        n = _octet(hashed, k)
        return (F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string")).when(c.rlike("[A-Z]"), F.char(F.pmod(n, F.lit(26)) + 65))
                .when(c.rlike("[a-z]"), F.char(F.pmod(n, F.lit(26)) + 97)).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), letter), "")


def _made_name(kind: Column, hashed: Column, attempt: Column, gender: Column) -> Column:
    """A name of three syllables and one more for each further attempt, in the script that the kind says."""
    out = F.lit("")
    for script, (syllables, female, male) in SYLLABLES.items():
        known = F.array(*[F.lit(s) for s in syllables.split()])
        body = _syllables(known, hashed, attempt)
        ending = F.when(~kind.startswith("given:"), "").when(gender == "f", female).when(gender == "m", male).otherwise("")
        out = F.when(kind.endswith(script), F.concat(body, ending)).otherwise(out)
    return out


def _syllables(known: Column, hashed: Column, attempt: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda k: F.get(known, F.pmod(_octet(hashed, k), F.size(known)))), "")


def _longer(hashed: Column, attempt: Column, past: int, first: int, size: int) -> Column:
    """One more character for each attempt after `past`: `size` characters from code point `first` on."""
    more = F.transform(F.sequence(F.lit(1), F.greatest(attempt - past, F.lit(1))), lambda k: F.char(F.pmod(_octet(hashed, k + 20), F.lit(size)) + first))
    return F.when(attempt > past, F.array_join(more, "")).otherwise("")


def surrogate(kind: Column, canon: Column, attempt: Column, key: str, gender: Column) -> Column:
    """The surrogate of a canonical value, itself in canonical form, at a numbered attempt.

    After EMAIL_ATTEMPTS an address gets letters in front, after SHAPED_ATTEMPTS other values get digits at the end, one more with each
    attempt: so a value without letters or digits, or one whose form has no free values left, is told apart as well.
    """
    seed = F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string"))
    hashed = F.sha2(seed, 512)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.pmod(_octet(hashed, k), F.lit(254)) + 1).cast("string")), ".")
    domain = F.regexp_extract(canon, r"\.([a-z]+)$", 1)
    letters, digits = _longer(hashed, attempt, EMAIL_ATTEMPTS, 97, 26), _longer(hashed, attempt, SHAPED_ATTEMPTS, 48, 10)
    octets = F.concat(octets, F.when(attempt > SHAPED_ATTEMPTS, ".").otherwise(""), digits)
    email = F.concat(letters, _shape(F.regexp_replace(canon, r"\.[a-z]+$", ""), hashed), F.lit("."), domain)
    iban = F.concat(F.substring(canon, 1, 2), _shape(F.substring(canon, 3, 64), hashed), digits)
    return (F.when(kind == "ip", octets).when(kind == "email", email).when(kind == "iban", iban)
            .when(kind.contains(":"), _made_name(kind, hashed, attempt, gender)).otherwise(F.concat(_shape(canon, hashed), digits)))


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of distinct (kind, canon): no surrogate is given twice in a kind or is a real value of it.

    Those that clash are drawn again with the next attempt; of several that want one surrogate, the earliest
    attempt and then the smallest value keeps it. So the result depends on the values and the key alone.
    A given name has the gender that more of its mentions have (`gender`, if there is such a column).
    """
    said = F.sum(F.when(F.col("gender") == "f", 1).when(F.col("gender") == "m", -1).otherwise(0))
    gender = F.when(said > 0, "f").when(said < 0, "m").otherwise("n").alias("gender")
    own = (entities if "gender" in entities.columns else entities.withColumn("gender", F.lit("n"))).groupBy("kind", "canon").agg(gender)
    table = cut_lineage(own.withColumn("attempt", F.lit(0)))
    while True:
        drawn = table.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key, F.col("gender")))
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("w"))
        real = table.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        checked = cut_lineage(drawn.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left").select(
            "kind", "canon", "gender", "attempt", "surrogate", ((F.col("w.canon") == F.col("canon")) & F.col("real").isNull()).alias("kept")))
        if checked.filter(~F.col("kept")).isEmpty():
            return checked.select("kind", "canon", "surrogate")
        table = checked.select("kind", "canon", "gender", F.when(F.col("kept"), F.col("attempt")).otherwise(F.col("attempt") + 1).alias("attempt"))


def _worn(form: Column, kind: Column, value: Column) -> Column:
    """A canonical surrogate written as the mention is: its separators, its case."""
    def step(state: Column, c: Column) -> Column:
        digit = c.rlike("[0-9A-Z]")
        return F.struct((state["at"] + F.when(digit, 1).otherwise(0)).alias("at"),
                        F.concat(state["out"], F.when(digit, F.substring(value, state["at"], F.lit(1))).otherwise(c)).alias("out"))

    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    spaced = F.aggregate(F.split(form, ""), start, step, lambda s: F.concat(s["out"], F.substring(value, s["at"], F.length(value))))
    cased = F.when(form == F.upper(form), F.upper(value)).when(kind.contains(":"), F.initcap(value)).otherwise(value)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spaced).when(kind == "ip", value).otherwise(cased)


def pseudonymised(docs: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """(doc_id, text, spans, n_<kind>...), one row per row of `docs`, with surrogates in place of entities.

    `spans` lists kind:start:end of the entities in the text given (code points, end exclusive). A match is the leftmost;
    at one place the first of `PATTERNS`. Digits need no check sum to count as a card or an account. Texts without
    entities are not shuffled; the join with the table of surrogates is salted, since one entity may be in any share of
    the rows. Null texts stay null; repeated rows and null ids stay; other columns are not read; an empty table
    gives an empty result. U+0001 in a text comes back as U+0002.
    """
    rows = shaped(docs, doc_id="long", text="string").withColumn("plain", unmarked(F.col("text")))
    hinted = F.col("plain").rlike(_HINT)
    split = _with_bare_names(rows.filter(hinted).withColumn("pieces", parts(F.col("plain"), ANY)).withColumn("text_key", F.xxhash64("plain")))
    found = cut_lineage(split.select("doc_id", "text_key", bound(F.col("pieces"), lambda p: mentions(p, F.col("givens"))).alias("m")).filter(F.size("m") > 0))
    found = found.dropDuplicates(["doc_id", "text_key"])
    each = found.select("doc_id", "text_key", F.explode("m").alias("m")).select("doc_id", "text_key", "m.*")
    table = assigned(each, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "part"), F.lit(salts)).cast("int"))
    worn = each.join(table, ["kind", "canon", "salt"]).select(
        "doc_id", "text_key", F.struct("part", "token", "kind", _worn(F.col("form"), F.col("kind"), F.col("surrogate")).alias("new")).alias("r"))
    by_row = worn.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_list("r")).alias("r"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    with_any = split.join(by_row, same, "left").withColumn("r", F.coalesce("r", F.array().cast(dict(by_row.dtypes)["r"])))
    at_part = F.transform("pieces", lambda p, k: F.when(F.pmod(k, F.lit(2)) == 0, p).otherwise(
        F.array_join(F.transform(F.filter("r", lambda x: x["part"] == k), lambda x: x["new"]), " ")))
    places = bound(F.col("pieces"), located)
    kinds = F.transform(F.filter("r", lambda x: x["token"] == 0), lambda x: F.when(x["kind"].contains(":"), "name").otherwise(x["kind"]))
    spans = F.array_join(F.transform(F.arrays_zip(kinds.alias("k"), places.alias("p")), lambda s: F.concat_ws(
        ":", s["k"], s["p"]["start"].cast("string"), s["p"]["end"].cast("string"))), ",")
    written = F.when(F.size("r") > 0, F.array_join(at_part, "")).otherwise(F.col("text"))
    done = with_any.select("doc_id", written.alias("text"), F.when(F.size("r") > 0, spans).otherwise("").alias("spans"), kinds.alias("kinds"))
    none = rows.filter(~hinted).select("doc_id", "text", F.lit("").alias("spans"), F.array().cast("array<string>").alias("kinds"))
    return done.unionByName(none).select("doc_id", "text", "spans", *[
        F.size(F.filter("kinds", lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS])
