"""Personal information inside free text.

Mentions are found by their form and validated, then replaced by a typed
placeholder.  Digits of numbers and dates go through a keyed Feistel
permutation within their format, other values through a keyed hash, so equal
values stay linked across documents and nothing can be read back without the
key.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Top-level domains of mailboxes besides two-letter country codes.
TLDS = "com|org|net|edu|gov|mil|int|info|biz|name|dev|app|io|ai|cloud|tech|online|site|store|shop|blog|email|mail|pro|jobs|museum|academy|systems|software|company|agency|digital|world|test|example|invalid|localhost|local"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?)"
_AT = r"(?:@|&#0*64;|&commat;|\s?[\[({]\s?(?:at|@)\s?[\])}]\s?)"
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
_TLD = rf"(?:{TLDS}|[A-Za-z]{{2}})(?![\w\-])(?!\.\w)"
EMAIL = re.compile(
    rf"(?<![\w.+\-@])(?:mailto:)?[A-Za-z0-9_][\w.+\-]{{0,63}}(?:{_AT}(?:{_HOST}{_DOT}){{1,5}}{_TLD}|\s(?:at|AT)\s(?:{_HOST}\s(?:dot|DOT)\s){{1,5}}{_TLD})", re.IGNORECASE
)

_EXT = r"(?:,?\s?(?:ext|x|extension|poste|durchwahl)\.?\s?\d{1,6})?"
PHONE = re.compile(
    r"(?<![\w.+\-/#:])(?:"
    r"(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,5}(?:[ .\-]?\d{2,5}){1,5})"  # international
    r"|00[1-9]\d{9,12}|00[1-9]\d{0,2}(?:[ .\-]\d{2,5}){2,5}"  # international with 00
    r"|(?:1[ .\-])?(?:\([2-9]\d{2}\)[ .\-]?|[2-9]\d{2}[ .\-])\d{3}[ .\-]\d{4}"  # North America
    r"|0\d{4}[ \-]\d{6}|0\d{3}[ \-]\d{3}[ \-]\d{4}|0\d{2}[ \-]\d{4}[ \-]\d{4}|\(0\d{2,4}\)[ \-]?\d{3,4}[ \-]?\d{3,4}"  # trunk prefix
    r"|0[1-9](?:[ .]\d{2}){4}"
    rf")(?![\w])(?![.\-]\d){_EXT}",
    re.IGNORECASE,
)

_ID_KIND = (
    r"(?:passport|passeport|pasaporte|passaporto|reisepass|driv(?:er|ing)(?:'?s)?[ \-]licen[cs]e|driver id|licen[cs]e (?:no|number)|f[üu]hrerschein|permis de conduire"
    r"|ssn|social (?:security|insurance)(?: (?:no|number|nr))?|sozialversicherungsnummer|ni(?:no)?(?= (?:no|number|nr))|national insurance|health insurance|insurance (?:policy|card)|policy holder|nhs"
    r"|tax(?:payer)?[ \-]?(?:id|identification|file|reference|payer)|tin|steuer[ \-]?(?:id|nummer)|nif|nie|dni|cpf|curp|codice fiscale|num[ée]ro fiscal"
    r"|national (?:id|identity|identification)|id[ \-]card|identity card|identity document|personal (?:id|identity|identification)|personalausweis|ausweis|carte d'identit[ée]|c[ée]dula|pesel|bsn|citizen id|voter id)"
)
_ID_VALUE = r"(?:[A-Za-z]{1,3}[ \-]?)?\d(?:[ \-./]?\d){3,15}(?:[ \-]?[A-Za-z](?![A-Za-z]))?"
ID_NUMBER = re.compile(rf"(?<!\w){_ID_KIND}(?:[ \-](?:card|code|document|no|nr|number|num|nummer|id))*[.:#=)]*\s?(?:is\s|was\s|of\s)?({_ID_VALUE})(?!\w)", re.IGNORECASE)
SSN = re.compile(r"(?<![\w.\-/])\d{3}-\d{2}-\d{4}(?![\w\-/]|\.\d)")

_U, _L = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮŁĽŃŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽ", "a-zß-öø-ÿāăąćčďđēėęěğģīįłľńňōőœřśşšťūůűźżž"
_CAP = rf"[{_U}][{_U}{_L}'’.\-]*"
_SUFFIX = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Court|Ct|Drive|Dr|Boulevard|Blvd|Way|Place|Pl|Square|Sq|Terrace|Crescent|Row|Hill|Gardens|Grove|Parkway|Pkwy|Highway|Hwy|Walk|Mews|Quay|Wharf|Circle|Trail|Alley)"
_FLAT = r"(?:Flat|Apt|Apartment|Unit|Suite|Room|Wohnung|Piso|Appt)\.?\s?#?\w{1,5}"
_RUE = r"(?:\s?(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route)\s"  # after the number
_TOWN = rf"(?:,\s(?:\d{{4,5}}\s)?[{_U}][{_U}{_L}'’\-]+(?:\s[{_U}][{_L}'’\-]+){{0,2}}(?:\s\d{{4,5}}(?:-\d{{4}})?)?)?"
ADDRESS = re.compile(
    rf"(?:(?<!\w){_FLAT},\s)?(?<![\w.\-/#])(?:"
    rf"\d{{1,5}}[a-z]?,?\s(?:{_CAP}\s){{1,4}}{_SUFFIX}\b\.?"
    rf"|\d{{1,5}}{_RUE}(?:(?:des?|du|de\sla|la|le|les)\s|de\sl'|d'|l')?{_CAP}(?:\s{_CAP})?"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Camino|Carrera|Rua|Travessa|Largo|Via|Viale|Piazza|Corso)\s(?:(?:del?|de\sla|de\slos|de\slas|do|da|dos|das|della|dei)\s)?{_CAP}(?:\s{_CAP})?,?\s\d{{1,5}}"
    rf"|[{_U}][{_U}{_L}\-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|chaussee|STRASSE|WEG|GASSE|ALLEE|PLATZ)\s\d{{1,4}}[a-z]?"
    rf")(?:,\s{_FLAT})?{_TOWN}(?:,\s{_FLAT})?(?!\w)"
)

# Words that open sentences or name things of the trade, not people.
NOT_NAMES = (
    "A|About|After|Again|All|Also|An|And|Another|Any|Applicant|Are|As|Ask|Assigned|At|Author|Be|Because|Before|Best|Between|Both|But|By|Call|Can|Cheers|Column|Contact|Could|Customer|Dear|Did|Do|Does|"
    "Each|Edit|Either|Every|Everything|Expected|False|First|For|From|Get|Give|Good|Greetings|Had|Has|Have|Hello|Her|Here|Hey|Hi|His|How|However|I|If|In|Instead|Into|Is|It|Its|Just|Keep|Kind|Last|Let|Like|"
    "Mail|Many|May|Maybe|Mobile|More|Most|My|New|Next|No|None|Not|Note|Now|Null|Of|On|Once|One|Only|Or|Order|Other|Our|Out|Over|Patient|Please|Reach|Regards|Reply|Right|Row|See|Setting|She|Should|Show|Signed|"
    "Since|So|Some|Still|Such|Tel|Text|Thank|Thanks|That|The|Their|Then|There|These|They|This|Those|To|True|Try|Two|Under|Unlike|Until|Up|Update|Use|User|Using|Very|Was|We|Were|What|When|Where|Which|While|Who|"
    "Why|Will|Windows|With|Without|Would|Yes|You|Your|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|June|July|August|September|October|November|December|"
    "Airflow|Amazon|Apache|Apple|Arrow|Azure|Bayes|Bayesian|Boosting|Carlo|Cloud|Code|Data|Databricks|Delta|Docker|Drive|Engine|Excel|Flink|Forest|Gaussian|Google|Gradient|Hadoop|Hive|Java|Kafka|Kernel|Lake|"
    "Learning|Linux|Machine|Markov|Microsoft|Monte|Naive|Neural|Numpy|Office|Oracle|Pandas|Parquet|Polars|Postgres|Power|Python|Query|Random|Redis|Regression|Ruby|Rust|Scala|Server|Sheets|Snowflake|Spark|Spring|"
    "Stack|Stage|Studio|Table|Tableau|Team|Torch|Tree|Visual|Street|Road|Avenue|Lane|Court|Close|Square|Place|Port|Old|North|South|East|West|Saint|San|Los|Las|Apt|Flat|Ave|Blvd|"
    "Select|Inner|Outer|Left|Join|Group|Having|Limit|Union|Insert|Values|Json|Csv|Sql|Api|Http|Https|Url|Utc|Error|Warning|Info|Debug"
)
_STOP = rf"(?!(?i:{NOT_NAMES}|{_SUFFIX})\b)"
_PART = rf"{_STOP}(?:[{_U}]['’]?[{_U}]?[{_L}]{{2,}}(?:-[{_U}][{_L}]+)?|[{_U}]{{3,}}(?:-[{_U}]{{3,}})?)(?![\w(]|\.\w)"
_INITIAL = rf"(?<![\w.])[{_U}]\."
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Miss|Sir|Herr|Frau|Mme|Señora?|Sra?|Ing|Dipl)\.?\s)?"
NAME = re.compile(rf"(?<![\w.@/\-\\&]){_TITLE}(?:{_PART}\s(?:{_INITIAL}\s)?{_PART}|{_INITIAL}\s(?:{_INITIAL}\s)?{_PART}|{_PART},\s(?:{_PART}|{_INITIAL}(?!\s?{_PART})))")
_CAPITALS = re.compile(rf"[{_U}]\S*,?\s[{_U}]")

# English names of months.
MONTHS = "January February March April May June July August September October November December".split()
_MONTH = rf"(?:{'|'.join(f'{m[:3]}(?:{m[3:]})?' if len(m) > 3 else m for m in MONTHS)})"
_DAY_FORMS = rf"(?:19|20)\d{{2}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s{_MONTH}\s(?:19|20)\d{{2}}|{_MONTH}\s\d{{1,2}},?\s(?:19|20)\d{{2}}|\d{{1,2}}([./])\d{{1,2}}\2(?:19|20)\d{{2}}"
DATE = re.compile(rf"\b(?:born|birth ?date|date of birth|d\.?o\.?b\.?|geboren|né(?:e)? le|nacid[oa])\b[\s:=]*(?:on\s|am\s|the\s|el\s)?({_DAY_FORMS})(?!\d)", re.IGNORECASE)

TYPES = {"email": "EMAIL", "street_address": "ADDRESS", "id_number": "ID", "phone": "PHONE", "birth_date": "DATE", "person_name": "NAME"}


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


# Cheap tests that a text must pass before a pattern is run over it; they never rule out a match.
# Those on folded text are for patterns that ignore case; each names what every form of its pattern has.
_MAY_EMAIL = ("@", "&#", "&commat")
_MAY_AT, _MAY_DOT = re.compile(r"[\[({]\s?at\s?[\])}]"), re.compile(r"dot\s")
_MAY_ID = ("pass", "pasa", "licen", "lizenz", "schein", "permis", "ssn", "ni n", "policy", "social", "sozial", "number", "insur", "nhs", "tax", "tin", "steuer", "ident", "id card", "id-card", "driver", "national id", "ausweis", "personal id", "voter", "citizen", "dula", "pesel", "bsn", "nif", "nie", "dni", "cpf", "curp", "fiscal", "nino", "num")
# each begins with one set of characters, so that the search leaps from one to the next
_MAY_NUMBER = (re.compile(r"\d[\d).]*[ .\-(]\(?\d{2}"), re.compile(r"\+\d"), re.compile(r"00[1-9]\d{9}"), re.compile(r"\(0\d{2,4}\)"))
_MAY_DATE = re.compile(r"born|birth|d\.?o\.?b|geboren|née? le|nacid")
_TAIL = re.compile(r"(?:ext|x|extension|poste|durchwahl)\.?\s?\d+$", re.IGNORECASE)
LEADING = (
    re.compile(rf"\d[a-z]?,?\s[{_U}]\S*\s(?:\S+\s){{0,3}}?{_SUFFIX}\b"), re.compile(rf"\d{_RUE}"),
    re.compile(r"(?:Calle|Avenida|Plaza|Paseo|Camino|Carrera|Rua|Travessa|Largo|Via|Viale|Piazza|Corso)\s"),
)
_GERMAN = re.compile(r"(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|chaussee|STRASSE|WEG|GASSE|ALLEE|PLATZ)\s\d")
_PAIR = re.compile(rf"([{_U}][\w'’\-]*)\.?,?\s(?=[{_U}])")
_INITIALS = re.compile(rf"[{_U}]\.\s[{_U}]")  # a name may begin with any initial, also one that is a word
_STOPPED = frozenset(NOT_NAMES.lower().split("|"))


def _wordlike(c: str) -> bool:
    return c.isalnum() or c in "_."


#: Letters that ignoring case takes for ASCII ones, besides what lower() turns into them.
_FOLDED = {0x131: "i", 0x17F: "s", 0x307: None}


def _folded(text: str) -> str:
    low = text.lower()
    return low if low.isascii() else low.translate(_FOLDED)


def find(text: str | None, *, cheap: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, type) of all mentions, in order, without overlaps; the more specific form wins.

    Without ``cheap`` every pattern is run, whatever its cheap test says.
    """
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if not any(start < e and s < end for s, e, _ in spans):
            spans.append((start, end, kind))

    low = _folded(text)
    if not cheap or any(k in low for k in _MAY_EMAIL) or _MAY_AT.search(low) or ("dot" in low and _MAY_DOT.search(low)):
        for m in EMAIL.finditer(text):
            if not m.group().lower().startswith("git@"):
                add(m.start(), m.end(), "email")
    if not cheap or any(p.search(text) for p in LEADING) or _GERMAN.search(text):
        for m in ADDRESS.finditer(text):
            add(m.start(), m.end(), "street_address")
    if not cheap or any(k in low for k in _MAY_ID):
        for m in ID_NUMBER.finditer(text):
            if _digits(m.group(1)) >= 5:
                add(m.start(1), m.end(1), "id_number")
    if not cheap or any(p.search(text) for p in _MAY_NUMBER):
        for m in SSN.finditer(text):
            add(m.start(), m.end(), "id_number")
        for m in PHONE.finditer(text):
            if 7 <= _digits(_TAIL.sub("", m.group())) <= 15:
                add(m.start(), m.end(), "phone")
    if not cheap or _MAY_DATE.search(low):
        for m in DATE.finditer(text):
            if _date(m.group(1)):
                add(m.start(1), m.end(1), "birth_date")
    if not cheap or any(not m.start() or not _wordlike(text[m.start() - 1]) for m in _INITIALS.finditer(text)) or any(w.lower() not in _STOPPED for w in _PAIR.findall(text)):
        for m in NAME.finditer(text):
            add(m.start(), m.end(), "person_name")
    return sorted(spans)


def _round(key: bytes, i: int, half: str, width: int) -> int:
    return int.from_bytes(hmac.new(key, f"{i}:{width}:{half}".encode(), hashlib.sha256).digest()[:16], "big")


def feistel(text: str, key: bytes, *, back: bool = False, rounds: int = 10, alphabet: str = "0123456789") -> str:
    """A keyed permutation of the strings of one length over an alphabet; ``back`` inverts it."""
    n, radix = len(text), len(alphabet)
    if n < 2:
        return text
    u, v = n // 2, n - n // 2

    def number(part: str) -> int:
        out = 0
        for c in part:
            out = out * radix + alphabet.index(c)
        return out

    def string(value: int, width: int) -> str:
        out = ""
        for _ in range(width):
            value, at = divmod(value, radix)
            out = alphabet[at] + out
        return out

    a, b = text[:u], text[u:]
    for i in reversed(range(rounds)) if back else range(rounds):
        m = u if i % 2 == 0 else v
        if back:
            a, b = string((number(b) - _round(key, i, a, n)) % radix**m, m), a
        else:
            a, b = b, string((number(a) + _round(key, i, b, n)) % radix**m, m)
    return a + b


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _in_place(value: str, turned: Iterator[str], wanted: Callable[[str], bool]) -> str:
    return "".join(next(turned) if wanted(c) else c for c in value)


def pseudonym_number(value: str, key: bytes, *, back: bool = False) -> str:
    """The number with its digits permuted, its capitals likewise, and all other characters in place."""
    digits = feistel("".join(c for c in value if c in "0123456789"), key, back=back)
    letters = feistel("".join(c for c in value if c in _LETTERS), key, back=back, alphabet=_LETTERS)
    return _in_place(_in_place(value, iter(digits), lambda c: c in "0123456789"), iter(letters), lambda c: c in _LETTERS)


# Calling codes of one and of two digits; all others have three.
CODES_1, CODES_2 = frozenset("17"), frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _prefix(value: str) -> int:
    """Digits of a phone number before its national part: calling code, exit code or trunk zero."""
    digits = "".join(c for c in value if c in "0123456789")
    zeros = 0 if value.lstrip("( ").startswith("+") else 2 if digits.startswith("00") else None
    if zeros is None:
        return 1 if digits.startswith("0") or (len(digits) == 11 and digits.startswith("1")) else 0
    code = digits[zeros:]
    n = zeros + (1 if code[:1] in CODES_1 else 2 if code[:2] in CODES_2 else 3)
    return n + (1 if digits[n : n + 1] == "0" else 0)


def pseudonym_phone(value: str, key: bytes, *, back: bool = False) -> str:
    """The number with its national part permuted in place, so that it is the same with and without a calling code; an extension is permuted by itself."""
    tail = _TAIL.search(value)
    main, rest = (value[: tail.start()], value[tail.start() :]) if tail else (value, "")
    digits = "".join(c for c in main if c in "0123456789")
    at = _prefix(main)
    turned = _in_place(main, iter(digits[:at] + feistel(digits[at:], key, back=back)), lambda c: c in "0123456789")
    inner = feistel("".join(c for c in rest if c in "0123456789"), key, back=back)
    return turned + _in_place(rest, iter(inner), lambda c: c in "0123456789")


_FIRST, _DAYS = dt.date(1900, 1, 1).toordinal(), 73_049  # 1900-01-01 to 2099-12-31


def _date(value: str) -> dt.date | None:
    """The day that one of the forms names; day before month where it is all numbers."""
    words = re.findall(r"\w+", value)
    try:
        if "-" in value:
            return dt.date.fromisoformat(value)
        if words[0].isdigit() and words[1].isdigit():
            return dt.date(int(words[2]), int(words[1]), int(words[0]))
        day, month = (words[0], words[1]) if words[0].isdigit() else (words[1], words[0])
        return dt.date(int(words[2]), [m[:3].lower() for m in MONTHS].index(month[:3].lower()) + 1, int(day))
    except (ValueError, IndexError):
        return None


def _in_form(day: dt.date, value: str) -> str:
    """Another day in the form of ``value``."""
    if "-" in value:
        return day.isoformat()
    words = re.findall(r"\w+", value)
    if words[1].isdigit() and words[0].isdigit():
        sep = value[len(words[0])]
        return f"{day.day:02d}{sep}{day.month:02d}{sep}{day.year}"
    name = MONTHS[day.month - 1]
    if words[0].isdigit():
        return f"{day.day} {name} {day.year}"
    return f"{name} {day.day}{',' if ',' in value else ''} {day.year}"


def pseudonym_date(value: str, key: bytes, *, back: bool = False) -> str:
    """Another valid date of 1900 to 2099 in the same form: the permutation is walked until it falls into the range."""
    day = _date(value)
    n = day.toordinal() - _FIRST if day else -1
    if not 0 <= n < _DAYS:
        return value
    while True:
        n = int(feistel(str(n).zfill(5), key, back=back))
        if n < _DAYS:
            return _in_form(dt.date.fromordinal(n + _FIRST), value)


def placeholder(kind: str, value: str, key: bytes) -> str:
    """A typed placeholder; equal values have equal ones.

    Numbers and dates keep their form, digits and capitals permuted; the digits
    are the same however the number is spelt.  Other values get a keyed hash of
    128 bits, so that different ones do not meet in a corpus of any size.
    """
    if kind == "phone":
        return f"[{TYPES[kind]} {pseudonym_phone(value, key)}]"
    if kind == "id_number":
        return f"[{TYPES[kind]} {pseudonym_number(value, key)}]"
    if kind == "birth_date":
        return f"[{TYPES[kind]} {pseudonym_date(value, key)}]"
    plain = re.sub(r"^mailto:", "", value.lower()) if kind == "email" else " ".join(sorted(re.findall(r"\w+", value.lower())))
    return f"[{TYPES[kind]} {hmac.new(key, f'{kind}:{plain}'.encode(), hashlib.sha256).hexdigest()[:32]}]"


def pseudonymised(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with each mention replaced and everything else untouched, and the mentions.

    A mention has its type, its number among those of its type, and its
    pseudonym, which links it to equal values in any other text.
    """
    out, at, found, seen = [], 0, [], Counter()
    for s, e, kind in find(text):
        mark = placeholder(kind, text[s:e], key)
        out += [text[at:s], mark]
        at = e
        seen[kind] += 1
        found.append({"pii_type": kind, "mention": seen[kind], "pseudonym": _link(kind, mark)})
    return "".join([*out, text[at:]]), found


def _link(kind: str, mark: str) -> str:
    """What equal values have in common whatever their spelling."""
    inner = mark.partition(" ")[2][:-1]
    if kind == "phone":
        main = _TAIL.sub("", inner)
        return "".join(c for c in main if c in "0123456789")[_prefix(main) :]
    if kind == "id_number":
        return "".join(c for c in inner.upper() if c.isalnum())
    return _date(inner).isoformat() if kind == "birth_date" and _date(inner) else inner


def redact_text(text: str, key: bytes) -> str:
    return pseudonymised(text, key)[0]


RESULT = "text string, mentions array<struct<pii_type:string,mention:bigint,pseudonym:string>>"


def redacted(text: Column, key: str) -> Column:
    """struct(text with typed placeholders, mentions); a null text stays null and has no mentions."""
    secret = key.encode()

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, []) if t is None else pseudonymised(t, secret) for t in texts], columns=["text", "mentions"])

    return F.pandas_udf(run, RESULT)(text)


def mentions(posts: DataFrame, keys: list[str], text: str, key: str) -> DataFrame:
    """(keys, pii_type, mention, pseudonym): one row per mention, numbered by type.

    Rows that agree in ``keys`` are one text.  Null and empty texts have no
    mentions; texts of any length are read whole; other columns are ignored.
    Rows stay where they are read; only the mentions are shuffled, to drop
    repeats.
    """
    return posts.select(*keys, F.explode(redacted(F.col(text), key)["mentions"]).alias("__m")).select(*keys, "__m.*").distinct()


def linked(found: DataFrame, post: list[str]) -> DataFrame:
    """(pii_type, pseudonym, posts, mentions): how often each value occurs, without the value."""
    per_post = found.groupBy("pii_type", "pseudonym", *post).agg(F.count(F.lit(1)).alias("n"))
    return per_post.groupBy("pii_type", "pseudonym").agg(F.count(F.lit(1)).alias("posts"), F.sum("n").alias("mentions"))
