"""Personal data as format-preserving Feistel pseudonyms, in DataFrame functions only.

Each value that is found and validated is replaced by a keyed permutation of its own format: equal values get equal pseudonyms in all
documents, different values stay different, and nothing can be traced back without the key.

kind     found as                                   validated by             permuted
email    local@domain                               -                        letters and digits of the local part
secret   32 to 128 hex digits                       has a digit and a letter the hex digits
ip       four dotted numbers                        each at most 255         the 32 bits
phone    +country and groups, or (999) 999-9999     8 to 15 digits           digits after the country code
iban     country, check digits, 11 to 30 others     remainder 97             digits after the check digits, which are made anew
card     13 to 19 digits, plain or grouped          Luhn                     digits between the first and the last, which is made anew
ssn      999-99-9999                                ranges in use            all digits, among valid numbers
date     9999-99-99, 99.99.9999, 99/99/9999         calendar, 1900 to 2099   the day, among all days of those years

Digits permute by a Feistel network of ROUNDS rounds (halves of the digit string, SHA-256 of key, kind, round and other half as round function);
domains that aren't a power of the base are walked until the result is valid. Values that fail validation stay as they are.

A phone number or IBAN ends where its neighbour begins: a phone has at most 15 digits and, once it has 8, takes no group that begins a value of another
kind; an IBAN of a registered country has that country's length. Bare groups of four digits just before a grouped card can't be told from the card.

Null texts stay null, empty ones empty; whole texts of any length are searched. Repeated rows each give a row, and ties can't occur. Columns other than
text pass through; columns named n_replaced or kinds are replaced. Control characters that mark matches inside are escaped first.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

ROUNDS, PIECE, STEPS = 10, 20, 64
#: Where no key is given: another one in every process, so that pseudonyms can't be reversed from this source.
PROCESS_KEY = secrets.token_hex(16)
#: The registered query's fixed key, for results that can be compared between runs. Not for real data.
TEST_KEY = "linkweave-test"
FIRST_DAY, DAYS = "1900-01-01", 73049

#: Registered countries by the length of their IBANs.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "phone": "",
    "iban": "",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![./-]?[0-9])",
}
LOCAL = r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}"


def phone_pattern() -> str:
    other = "|".join([*(PATTERNS[k] for k in ("email", "secret", "ip", "ssn", "date")), rf"(?<![0-9])(?:{LOCAL})(?![0-9])"])
    # after a country code, a grouped card has too many digits for a phone
    start = r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\)|[ .-]?(?![0-9]{4}(?:(?:[ -][0-9]{4}){3}|[ -][0-9]{6}[ -][0-9]{5})(?![0-9]))[0-9]{1,4})"
    digit = r"[ .()-]{0,2}[0-9]"  # spelled out, as a lookbehind takes no repeated groups
    size = rf"\+{digit * 8}{f'(?:{digit})?' * 7}"
    # a phone's last group and a card's first ones look like a card too, so cards count from 8 digits on
    own = rf"(?!{other})(?!(?<={size}[ .-]){PATTERNS['card']})"
    # another kind's form inside is taken only whole, where too few digits are before it
    return rf"(?<![0-9+])(?:{start}(?:[ .-]?{own}[0-9]{{2,4}}){{2,4}}(?<={size})|{start}(?:[ .-]?[0-9]{{2,4}}){{2,4}}(?<={size})(?![.-][0-9])|{LOCAL})(?![0-9])"


def iban_pattern() -> str:
    known = []
    for size, countries in IBANS.items():
        groups, rest = divmod(size - 4, 4)
        spaced = f"(?: [A-Z0-9]{{4}}){{{groups}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")
        known.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{size - 4}}}|{spaced})(?![A-Za-z0-9])")
    other = "|".join([*(PATTERNS[k] for k in ("email", "secret", "ip", "ssn", "date")), rf"(?:{LOCAL})(?![0-9])"])
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(known)}|[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: (?!{other})[A-Z0-9]{{4}}){{2,7}}(?: (?!{other})[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9]))"


PATTERNS["phone"] = phone_pattern()
PATTERNS["iban"] = iban_pattern()
ANY = "|".join(PATTERNS.values())
MARK, ESCAPE = "\x01", "\x02"


def char(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def feistel(s: Column, radix: int, tweak: str, key: str) -> Column:
    """A permutation of the strings of s's length over the digits of the radix (upper case); at most PIECE digits."""

    def one(state: Column, i: Column) -> Column:
        a, b = state["a"], state["b"]
        f = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), F.length(a).cast("string"), b), 256), 1, 15), 16, 10).cast("long")
        whole = F.pow(F.lit(float(radix)), F.length(a)).cast("long")
        c = F.pmod(F.coalesce(F.conv(a, radix, 10), F.lit("0")).cast("long") + f, whole)
        return F.struct(b.alias("a"), F.lpad(F.conv(c.cast("string"), 10, radix), F.length(a), F.lit("0")).alias("b"))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one), lambda x: F.concat(x["a"], x["b"]))


def permuted(s: Column, radix: int, tweak: str, key: str) -> Column:
    """Like feistel, for strings of any length, in pieces; each piece's place is part of the permutation's input."""
    pieces = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / PIECE).cast("int"))
    many = F.array_join(F.transform(pieces, lambda k: feistel(F.substring(s, k * PIECE + 1, F.lit(PIECE)), radix, tweak, key)), "")
    return F.when(F.length(s) == 0, "").when(F.length(s) <= PIECE, feistel(s, radix, tweak, key)).otherwise(many)


def walked(s: Column, radix: int, tweak: str, key: str, valid: Callable[[Column], Column]) -> Column:
    """Permutes until the result is valid: a permutation of the valid strings.

    Null if it is not valid after STEPS more, which hardly happens, as seven in ten strings of each domain here are valid: such a value stays as it is.
    """
    step = lambda acc, _: F.when(valid(acc), acc).otherwise(feistel(acc, radix, tweak, key))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), feistel(s, radix, tweak, key), step), lambda r: F.when(valid(r), r))


def only(s: Column, keep: str) -> Column:
    return F.regexp_replace(s, f"[^{keep}]", "")


def laid_out(pattern: Column, digits: Column, letters: Column | None = None) -> Column:
    """pattern with its digits (and letters, keeping their case) replaced in order."""

    def put(acc: Column, i: Column) -> Column:
        c = char(pattern, i)
        d, n = c.rlike("[0-9]"), acc["d"]
        out = F.when(d, char(digits, n)).otherwise(c)
        if letters is not None:
            x = char(letters, acc["l"])
            out = F.when(c.rlike("[a-z]"), F.lower(x)).when(c.rlike("[A-Z]"), F.upper(x)).otherwise(out)
        is_letter = c.rlike("[A-Za-z]")
        return F.struct(F.concat(acc["out"], out).alias("out"), (n + d.cast("int")).alias("d"), (acc["l"] + is_letter.cast("int")).alias("l"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("d"), F.lit(1).alias("l"))
    return F.aggregate(F.sequence(F.lit(1), F.length(pattern)), start, put)["out"]


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""

    def add(acc: Column, i: Column) -> Column:
        d = char(digits, F.length(digits) - i + 1).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def rest97(s: Column) -> Column:
    """The remainder modulo 97 of the number that s spells, letters as 10 to 35."""

    def add(acc: Column, i: Column) -> Column:
        c = char(s, i)
        return F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _email(p: Column, key: str) -> Column:
    local, domain = F.substring_index(p, "@", 1), F.substring_index(p, "@", -1)
    low, high = "abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOP"
    letters = F.translate(permuted(F.translate(F.lower(only(local, "A-Za-z")), low, high), 26, "letters", key), high, low)
    return F.concat(let(F.struct(local.alias("p"), permuted(only(local, "0-9"), 10, "digits", key).alias("d"), letters.alias("l")), lambda x: laid_out(x["p"], x["d"], x["l"])), F.lit("@"), domain)


def _secret(p: Column, key: str) -> Column:
    new = permuted(F.upper(p), 16, "secret", key)
    mixed = p.rlike("[0-9]") & p.rlike("[A-Fa-f]")
    return F.when(mixed, F.when(p.rlike("[a-f]"), F.lower(new)).otherwise(new))


def _ip(p: Column, key: str) -> Column:
    parts = F.split(p, r"\.")
    ok = F.forall(parts, lambda x: x.cast("int") <= 255)
    raw = F.array_join(F.transform(parts, lambda x: F.lpad(F.conv(x, 10, 16), 2, "0")), "")
    new = let(feistel(raw, 16, "ip", key), lambda h: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10)), "."))
    return F.when(ok, new)


def _phone(p: Column, key: str) -> Column:
    code = F.when(p.startswith("+"), F.regexp_extract(p, r"^\+([0-9]{1,3}(?=[^0-9])|[0-9])", 1)).otherwise("")

    def new(x: Column) -> Column:
        n = x["n"]
        return F.when(F.length(x["all"]).between(8, 15), laid_out(x["p"], F.concat(x["code"], walked(n, 10, "phone", key, lambda y: (char(n, F.lit(1)) < "2") | (char(y, F.lit(1)) >= "2")))))

    all_ = only(p, "0-9")
    return let(F.struct(p.alias("p"), code.alias("code"), all_.alias("all"), F.substring(all_, F.length(code) + 1, F.lit(20)).alias("n")), new)


def _iban(p: Column, key: str) -> Column:
    def new(x: Column) -> Column:
        s = x["s"]
        country, body = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
        other = laid_out(body, permuted(only(body, "0-9"), 10, "iban", key))
        check = lambda b: F.lpad((98 - rest97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        made = let(other, lambda b: F.concat(country, check(b), b))
        # the letters are the same, so the pattern's own letters can stay
        return F.when((F.length(s) >= 15) & (rest97(F.concat(body, F.substring(s, 1, 4))) == 1), laid_out(x["p"], only(made, "0-9")))

    return let(F.struct(p.alias("p"), F.replace(p, F.lit(" "), F.lit("")).alias("s")), new)


def _card(p: Column, key: str) -> Column:
    def new(x: Column) -> Column:
        s = x["s"]
        made = F.concat(char(s, F.lit(1)), feistel(F.substring(s, F.lit(2), F.length(s) - 2), 10, "card", key))
        full = let(made, lambda m: F.concat(m, ((10 - luhn(F.concat(m, F.lit("0")))) % 10).cast("string")))
        return F.when(luhn(s) == 0, laid_out(x["p"], full))

    return let(F.struct(p.alias("p"), only(p, "0-9").alias("s")), new)


def _ssn(p: Column, key: str) -> Column:
    ok = lambda s: ~s.rlike("^(000|666|9)") & (F.substring(s, 4, 2) != "00") & (F.substring(s, 6, 4) != "0000")
    return let(F.struct(p.alias("p"), only(p, "0-9").alias("s")), lambda x: F.when(ok(x["s"]), laid_out(x["p"], walked(x["s"], 10, "ssn", key, ok))))


def _date(p: Column, key: str) -> Column:
    a, b = F.substring(p, 1, 2), F.substring(p, 4, 2)
    form = F.when(p.rlike("-"), "yyyy-MM-dd").when(p.rlike(r"\."), "dd.MM.yyyy").when(a.cast("int") <= 12, "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    iso = F.when(form == "yyyy-MM-dd", p).otherwise(F.concat_ws("-", F.substring(p, 7, 4), F.when(form == "MM/dd/yyyy", a).otherwise(b), F.when(form == "MM/dd/yyyy", b).otherwise(a)))
    n = F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date"))

    def new(x: Column) -> Column:
        day = walked(F.lpad(x["n"].cast("string"), 5, "0"), 10, "date", key, lambda s: s.cast("int") < DAYS)
        y = F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))
        shown = let(y, lambda d: F.when(x["f"] == "yyyy-MM-dd", F.date_format(d, "yyyy-MM-dd")).when(x["f"] == "dd.MM.yyyy", F.date_format(d, "dd.MM.yyyy")).when(x["f"] == "MM/dd/yyyy", F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy")))
        return F.when(x["n"].between(0, DAYS - 1), shown)

    return let(F.struct(n.alias("n"), form.alias("f")), new)


MAKERS = {"email": _email, "secret": _secret, "ip": _ip, "phone": _phone, "iban": _iban, "card": _card, "ssn": _ssn, "date": _date}


def replacement(p: Column, key: str) -> Column:
    """struct(out, kind) of one match; a value that isn't valid stays, with kind null."""
    made = F.lit(None).cast("struct<kind: string, new: string>")
    for kind in reversed(MAKERS):
        made = F.when(p.rlike(f"^(?:{PATTERNS[kind]})$"), F.struct(F.lit(kind).alias("kind"), MAKERS[kind](p, key).alias("new"))).otherwise(made)
    return let(made, lambda x: F.struct(F.coalesce(x["new"], p).alias("out"), F.when(x["new"].isNotNull(), x["kind"]).alias("kind")))


def pseudonymise(df: DataFrame, key: str | None = None) -> DataFrame:
    """df with text pseudonymised, n_replaced and kinds (comma-separated, sorted).

    The key is a secret of the caller's; runs with one key give linkable pseudonyms. Without one, values are linked within this process only.
    """
    key = key or PROCESS_KEY
    text = F.col("text").cast("string")
    odd = text.contains(MARK) | text.contains(ESCAPE)
    safe = F.when(odd, F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "\x03")), F.lit(MARK), F.lit(ESCAPE + "\x04"))).otherwise(text)
    parts = F.split(F.regexp_replace(safe, ANY, f"{MARK}$0{MARK}"), MARK)
    plain = lambda p: F.struct(p.alias("out"), F.lit(None).cast("string").alias("kind"))
    done = F.when(text.rlike("[0-9@]"), F.transform(parts, lambda p, i: F.when(i % 2 == 1, replacement(p, key)).otherwise(plain(p))))
    d = df.drop("n_replaced", "kinds").withColumn("__parts", done)
    joined = F.array_join(F.transform("__parts", lambda x: x["out"]), "")
    joined = F.when(odd, F.replace(F.replace(joined, F.lit(ESCAPE + "\x04"), F.lit(MARK)), F.lit(ESCAPE + "\x03"), F.lit(ESCAPE))).otherwise(joined)
    kinds = F.transform(F.filter("__parts", lambda x: x["kind"].isNotNull()), lambda x: x["kind"])
    return d.select(
        *[F.when(F.col("__parts").isNull(), text).otherwise(joined).alias("text") if c == "text" else F.col(c) for c in d.columns if c != "__parts"],
        F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias("n_replaced"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(kinds)), ","), F.lit("")).alias("kinds"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(common.documents(spark, sf_dir).select("doc_id", "text"), TEST_KEY)
