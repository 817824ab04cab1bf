"""Template residue, filler and error-page text.

A positive-unlabelled naive Bayes over passages (sentences and lines): passages
that are residue beyond doubt are trusted positives and serve as seeds of the
fit, all others are unlabelled, and expectation-maximization finds the residue
among them.  A record is a case if the evidence of its passages and of what
stands around them (navigation, length) adds up to residue; rules decide
nothing once the model is fitted.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records that the classifier is fitted on at most, taken by a hash.
FIT_RECORDS = 40_000

# An unfilled slot in the syntax of common template engines.
_NAME = r"[A-Za-z][\w.\-]*(?:[ _][\w.\-]+){0,3}"
SLOT = re.compile(
    rf"\{{\{{\s*{_NAME}\s*(?:\|[^{{}}]*)?\}}\}}|\$\{{\s*{_NAME}\s*\}}|#\{{\s*{_NAME}\s*\}}|<%[=-]?\s*{_NAME}\s*%>|%%\s*{_NAME}\s*%%|@@\s*{_NAME}\s*@@"
    rf"|\[\[\s*{_NAME}\s*\]\]|__[A-Z][A-Z0-9_.\-]*__|\[(?:insert|your|enter|add)\s[^\]\[]{{1,40}}\]|<(?:insert|your|enter)\s[^<>]{{1,40}}>|\{{%[^%{{}}]{{0,80}}%\}}|(?<![\w$#{{\\]){{\s*{_NAME}\s*}}(?!}})|%\({_NAME}\)s|\bundefined\b",
    re.IGNORECASE,
)
#: [first name]: square brackets alone are only a slot where no link or index follows.
BRACKET = re.compile(rf"(?<![\w\]!])\[{_NAME}\](?![\[(])")
_TAG = re.compile(r"<(?:!--.*?--|/?(?:html|head|body|title|p|div|span|noscript|br|h[1-6]|meta|center|hr|section|main|b|i|em|strong|ul|ol|li|a|table|tr|td|th)\b[^<>]*)>", re.IGNORECASE | re.DOTALL)
_TITLE = re.compile(r"<(title|style|script)\b[^<>]*>.*?</\1>", re.IGNORECASE | re.DOTALL)
_QUOTED = re.compile(r"\"[^\"\n]{8,}\"|“[^”\n]{8,}”|«[^»\n]{8,}»|„[^“\n]{8,}“|`[^`\n]+`|<code>(?:(?!<code>).)*?</code>", re.DOTALL)
_MAY_QUOTE, _MAY_SLOT = re.compile(r"[\"“«„`<]"), re.compile(r"[{\[<%@]|__|[uU][nN][dD][eE][fF]")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")
_MARKER = re.compile(r"^(?:[*>|\-]+|#+|\d+[.)])\s+")
_IDENTIFIER = re.compile(r"\b[A-Za-z]\w*_\w+\b|\w+\(\)|\b[a-z]+\.[a-z]+\.[a-z]+\b|[=;{}\[\]<>]{2,}|\S[=<>]\S")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_DIGITS = re.compile(r"\d+")

# Words of site navigation; a line of nothing else is a navigation line.
NAVIGATION = frozenset(
    "about account advertise all answers api app ask back badges blog browse business by careers categories companies company contact content cookie cookies culture data "
    "developer faq feedback footer for forgot forums go help home in jobs join language legal links log login logout main menu mobile more my navigation "
    "new next of our page password policy popular press previous print privacy products profile questions recent register related rss search settings share sign "
    "site sitemap skip status store subscribe support tags team teams terms the to top topics tour unanswered up use user users work".split()
)
# The word stock of the common Latin filler text.
LATIN_FILLER = frozenset(
    "ac accumsan adipiscing aliqua aliquam aliquet amet anim ante arcu at auctor augue aute bibendum cillum commodo condimentum congue consectetur consequat convallis cras "
    "culpa cupidatat curabitur cursus dapibus deserunt diam dictum dignissim do dolor dolore donec duis ea efficitur egestas eget eiusmod eleifend elementum elit enim erat "
    "eros esse est et etiam eu euismod ex excepteur exercitation facilisis faucibus felis fermentum feugiat finibus fringilla fugiat fusce gravida habitant hendrerit iaculis "
    "id imperdiet in incididunt integer interdum ipsum irure justo labore laboris lacinia lacus laoreet lectus leo libero ligula lobortis lorem luctus maecenas magna malesuada "
    "massa mattis mauris maximus metus mi minim molestie mollis mollit morbi nam nec neque nibh nisi nisl non nostrud nulla nullam nunc occaecat odio officia orci ornare pariatur "
    "pellentesque pharetra phasellus placerat porta porttitor posuere praesent pretium proident proin pulvinar purus quam qui quis reprehenderit rhoncus risus rutrum sagittis "
    "sapien scelerisque sed sem semper sint sit sodales sollicitudin sunt suscipit suspendisse tellus tempor tempus tincidunt tortor tristique turpis ullamco ultrices ultricies "
    "urna ut varius vehicula vel velit venenatis veniam vestibulum vitae vivamus viverra volutpat voluptate vulputate".split()
)
# Openings that only error pages, access or maintenance messages and script notices have, in several languages.
TRUSTED = re.compile(
    r"^(?:error\s+)?[45]\d\d\s*[:\-–]?\s*(?:not found|bad gateway|forbidden|internal server error|service (?:temporarily )?unavailable|unauthorized|gateway time-?out|gone|bad request|too many requests)\b"
    r"|^http (?:status|error)(?: code)?\s*:?\s*\d{2,3}\b"
    r"|^(?:error|errore|fehler|erreur|erro|fout|fel|feil|fejl|virhe|błąd|chyba|hiba|hata|ошибка|помилка|エラー|错误|錯誤|오류)\s*:?\s*[45]\d\d\b"
    r"|^(?:access (?:to this page )?(?:is |has been )?denied|forbidden)\b|^(?:page|seite|página|pagina)\s+(?:not found|nicht gefunden|no encontrada|não encontrada|non trovata)\b"
    r"|^page introuvable|^страница не найдена|^ページが見つかりません|^页面不存在|^accès refusé|^acceso denegado|^acesso negado|^zugriff verweigert|^доступ запрещ"
    r"|^(?:please |you (?:need|have) to )?(?:enable|activate|turn on|allow) (?:java)?scripts?\b.{0,60}$|^(?:this (?:page|site|app|application) )?(?:needs|requires) java ?scripts?\b"
    r"|^java ?script (?:is|must be|has to be|needs to be|seems to be) (?:disabled|enabled|required|turned (?:on|off)|switched off)"
    r"|^(?:veuillez )?activer? (?:le |el )?java ?script\b|^activez java ?script|^(?:por favor,? )?(?:active|habilite|ative|activa|habilita) (?:el |o )?java ?script\b"
    r"|^(?:bitte )?aktivieren sie (?:bitte )?java ?script|^(?:пожалуйста,? )?включите javascript|^для .{3,40} включите javascript|^.{0,30}javascript を有効に"
    r"|^(?:our |this |the )?(?:site|website|service|server|page) is (?:currently |temporarily )?(?:down|offline|closed|under (?:construction|maintenance)|unavailable)\b"
    r"|^(?:content |page )?(?:coming soon|under construction|under maintenance)\W*$|^too many requests\b|^checking your browser\b|^scheduled maintenance\b"
    r"|^(?:your )?session (?:has )?(?:expired|timed out)\b|^(?:please )?log ?in (?:again )?to (?:continue|view|see)\b|^(?:sorry|oops)[,!.]? something went wrong\b"
    r"|^this (?:page|post|question|answer|content|document) (?:was|has been) (?:\w+ )?(?:removed|deleted)\b|^(?:your )?(?:content|description|title|body|answer) goes here\b|^add (?:a|your) (?:description|title|text)\b"
    r"|^(?:replace this text|insert (?:your )?text here|your text (?:goes )?here|sample text|placeholder text|dummy text|text to be supplied)\b",
    re.IGNORECASE,
)


def _up_to(pattern: re.Pattern, put: str, text: str, ends: tuple[str, ...]) -> str:
    """``pattern.sub`` on the text up to the last of its ends; beyond that nothing can close, and nothing is searched."""
    low = text.lower()
    if len(low) != len(text):  # some letter changes its length
        return pattern.sub(put, text)
    at = max((k + len(e) for e in ends if (k := low.rfind(e)) >= 0), default=0)
    return pattern.sub(put, text[:at]) + text[at:] if at else text


def passages(text: str | None) -> list[str]:
    """Sentences and lines of a text, tags dropped; a fragment of a line stays with the sentence before it."""
    text = text or ""
    plain = _TAG.sub("\n", _up_to(_TITLE, "\n", text, ("</title>", "</style>", "</script>"))) if "<" in text else text
    out = []
    for line in plain.split("\n"):
        line = _MARKER.sub("", " ".join(line.split()))
        parts: list[str] = []
        for p in _SENTENCE.split(line):
            if parts and len(_WORD.findall(p)) < 4:
                parts[-1] += " " + p
            elif p:
                parts.append(p)
        out += [p for p in parts if any(c.isalnum() for c in p)]
    return out


def is_navigation(passage: str) -> bool:
    ws = _WORD.findall(passage.lower())
    return len(ws) > 0 and all(w in NAVIGATION for w in ws) and not re.search(r"[.!?:]$|[\[\]{}<>%$@#_]", passage)


def _mash(words: list[str]) -> bool:
    """Keys hit at random: hardly any vowels over a run of letters."""
    letters = "".join(words)
    return len(letters) >= 12 and letters.isascii() and sum(c in "aeiouy" for c in letters) * 5 < len(letters) and len(set(words)) > 1


def features(passage: str) -> set[str]:
    """Lower-case words and pairs of words, with slots, quotations, repeats and random keys named as such."""
    quoted = _MAY_QUOTE.search(passage) is not None and _QUOTED.search(passage) is not None
    s = _QUOTED.sub(" ", passage) if quoted else passage
    slots = more = 0
    if _MAY_SLOT.search(s):
        s, slots = SLOT.subn(" <slot> ", s)
        s, more = BRACKET.subn(" <slot> ", s)
    code = _IDENTIFIER.search(s.replace("<slot>", " ")) is not None
    ws = [w if not w.isdigit() else "<n>" for w in _WORD.findall(s.replace("<slot>", " slotmark ").lower())]
    words = [w for w in ws if w != "slotmark"]
    out = set(words) | {f"{a} {b}" for a, b in zip(ws, ws[1:])} - {"slotmark slotmark"}
    if quoted:
        out.add("<quoted>")
    if code:
        out.add("<code>")
    if slots + more:
        out.add("<slot>")
        if (slots + more) * 4 >= len(words):
            out.add("<slots>")
    alone = [w for w in words if w != "<n>"]
    if len(alone) >= 4 and len(set(alone)) <= 2:
        out.add("<repeat>")
    if _mash(alone):
        out = {"<mash>"}
    elif alone and sum(w in LATIN_FILLER for w in alone) * 5 >= len(alone) * 4 and len(alone) >= 3:
        out.add("<latin>")
    return out


def trusted(passage: str, marks: set[str] | None = None) -> bool:
    """Residue beyond doubt; ``marks`` are its features where they are known."""
    f = features(passage) if marks is None else marks
    if "<quoted>" in f:
        return False
    return bool(f & {"<slots>", "<repeat>", "<mash>", "<latin>"}) or ("<code>" not in f and TRUSTED.search(passage) is not None)


#: Kinds of residue, each a component of its own: template wording, filler, and messages.
KINDS = ("slots", "filler", "notice")


def kind_of(marks: set[str]) -> int:
    return 0 if "<slots>" in marks else 1 if marks & {"<latin>", "<mash>", "<repeat>"} else 2


def surroundings(n_navigation: int, content: list[str]) -> tuple[str, str]:
    """What is known of a record besides its passages: navigation around them, and how long they are (log2 of words)."""
    n = sum(len(p.split()) for p in content)
    return ("<nav>" if n_navigation else "<no nav>", f"<words {min(10, (n + 1).bit_length() - 1)}>")


def parts(text: str | None) -> tuple[tuple[str, str], list[str]]:
    """(surroundings, passages that are no navigation) of a record."""
    ps = passages(text)
    content = [p for p in ps if not is_navigation(p)]
    return surroundings(len(ps) - len(content), content), content


class Model(NamedTuple):
    """Log-odds: of a record at large, by its surroundings, and by feature for each kind of residue."""

    prior: float
    around: dict[str, float]
    odds: dict[str, tuple[float, float, float]]


#: A corpus without trusted passages has no residue to learn.
NOTHING = Model(-30.0, {}, {})
#: Pseudo-count of a feature, bounds of its log-odds, weight of a passage against the root of its features (they overlap, so
#: evidence grows with the root of the length), and how much residue can speak for a record: a page repeats itself, so that is
#: bounded, while what speaks for real content adds up.
SMOOTH, LOW, HIGH, SCALE, CAP = 2.0, -3.0, 4.0, 1.2, 8.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def fit(records: Iterable[str | None], *, rounds: int = 20, tolerance: float = 0.5, seeds: Callable[[str, set[str]], bool] | None = None) -> Model:
    """Positive-unlabelled naive Bayes by expectation-maximization.

    ``records`` are texts drawn at random.  ``seeds`` tells whether a passage with
    these features is trusted (by default ``trusted``).

    The unit of counting is the distinct passage, digits aside: a template
    counts once however often it was stamped out, so that its words do not look
    like words of real text.  The M step takes each distinct passage for residue
    by the mean responsibility of the records it stands in (trusted ones always)
    and counts its features for its kind of residue, and for real text by the
    rest.  The E step judges every record as ``judge`` does.  In the first round
    records with trusted beside other passages are left out, so that what stands
    beside residue is not learned as real text.
    """
    seeds = seeds or (lambda p, f: trusted(p, f))
    number: dict[str, int] = {}  # distinct passage
    vocabulary: dict[str, int] = {}
    feature_of, lengths, sure, kind = array("l"), array("l"), array("b"), array("b")
    record_of, passage_of, sizes, around = array("l"), array("l"), array("l"), []
    for text in records:
        where, content = parts(text)
        if not content:
            continue
        for p in content:
            key = _DIGITS.sub("#", p.lower())
            k = number.setdefault(key, len(number))
            if k == len(lengths):
                f = features(p)
                feature_of.extend(vocabulary.setdefault(x, len(vocabulary)) for x in f)
                lengths.append(len(f))
                sure.append(seeds(p, f))
                kind.append(kind_of(f))
            record_of.append(len(sizes))
            passage_of.append(k)
        sizes.append(len(content))
        around.append(where)
    sure_ = np.array(sure, dtype=bool)
    if not sure_.any():
        return NOTHING
    feature, length, kinds = np.array(feature_of), np.array(lengths), np.array(kind)
    rec, pas = np.array(record_of), np.array(passage_of)
    of = np.repeat(np.arange(len(length)), length)  # passage of every feature entry
    n_rec, n_pas, n_feat = len(sizes), len(length), len(vocabulary)
    root = np.sqrt(np.maximum(length, 1))
    marks = sorted({w for ws in around for w in ws})
    mark = np.array([[marks.index(w) for w in ws] for ws in around])
    n_sure = np.bincount(rec, weights=sure_[pas], minlength=n_rec)
    whole, mixed = n_sure == np.array(sizes), (n_sure > 0) & (n_sure < np.array(sizes))
    z, use = whole.astype(float), ~mixed  # responsibilities; records that count in this round
    for _ in range(rounds):
        w = use[rec].astype(float)
        stands = np.bincount(pas, weights=w, minlength=n_pas)
        share = np.where(sure_, 1.0, np.bincount(pas, weights=w * z[rec], minlength=n_pas) / np.maximum(stands, 1))
        live = (stands > 0) | sure_
        real = np.where(live, 1 - share, 0.0)
        u, n_u = np.bincount(feature, weights=real[of], minlength=n_feat), real.sum()
        table = np.zeros((n_feat, len(KINDS)))
        for c in range(len(KINDS)):
            mine = np.where(live & (kinds == c), share, 0.0)
            n_p = max(mine.sum(), 1.0)
            pi = n_p / (n_p + n_u)
            p = np.bincount(feature, weights=mine[of], minlength=n_feat)
            table[:, c] = np.clip(np.log((p + SMOOTH * pi) / pi) - np.log((u + SMOOTH * (1 - pi)) / (1 - pi)), LOW, HIGH)
        a, b = z[use].sum(), (1 - z[use]).sum()
        prior = math.log((a + 1) / (b + 1))
        with_a = np.bincount(mark[use].ravel(), weights=np.repeat(z[use], 2), minlength=len(marks))
        with_b = np.bincount(mark[use].ravel(), weights=np.repeat(1 - z[use], 2), minlength=len(marks))
        at = np.log((with_a + SMOOTH * (a + 1) / (a + b + 2)) / (a + SMOOTH)) - np.log((with_b + SMOOTH * (b + 1) / (a + b + 2)) / (b + SMOOTH))
        evidence = np.max([np.bincount(of, weights=table[feature, c], minlength=n_pas) for c in range(len(KINDS))], axis=0) / root * SCALE
        each = evidence[pas]
        total = prior + at[mark].sum(axis=1) + np.minimum(CAP, np.bincount(rec, weights=np.maximum(each, 0), minlength=n_rec)) + np.bincount(rec, weights=np.minimum(each, 0), minlength=n_rec)
        new = np.where(whole, 1.0, _sigmoid(total))
        moved, z, use = np.abs(new - z).sum(), new, np.ones(n_rec, dtype=bool)
        if moved < tolerance:
            break
    kept = (np.abs(table) > 0.6).any(axis=1)  # a word of one real passage says next to nothing
    return Model(prior, dict(zip(marks, at.tolist(), strict=True)), {f: tuple(table[i].tolist()) for f, i in vocabulary.items() if kept[i]})


def evidence(marks: set[str], odds: dict[str, tuple[float, float, float]]) -> float:
    """Log-odds that a passage is residue of the likeliest kind; features the fit never saw count nothing."""
    a = b = c = 0.0
    for f in marks:
        if (x := odds.get(f)) is not None:
            a, b, c = a + x[0], b + x[1], c + x[2]
    return max(a, b, c) / math.sqrt(len(marks) or 1) * SCALE


def judge(text: str | None, model: Model) -> tuple[bool, float]:
    """(is residue, log-odds) of a record: prior, surroundings, and the evidence of all passages.

    A record without passages besides navigation is no residue.  Where even the
    bounded evidence for residue cannot make up for the real content seen so
    far, the answer is known, and the log-odds are an upper bound.
    """
    where, content = parts(text)
    if not content:
        return False, LOW * CAP
    total, good = model.prior + sum(model.around.get(w, 0.0) for w in where), 0.0
    for p in content:
        x = evidence(features(p), model.odds)
        if x > 0:
            good += x
        else:
            total += x
            if total + CAP <= 0:
                return False, total + CAP
    total += min(CAP, good)
    return total > 0, total


def fit_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample of at most FIT_RECORDS records; the trusted passages in it are the seeds.

    Records are taken by a hash of their id and text, so the sample is spread
    over the whole table and the same for the same table.
    """
    n = docs.count()  # from the footers
    keyed = docs.where(F.col(text).isNotNull()).select(F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("t"))
    share = math.ceil(1_000_003 * min(1.0, 1.05 * FIT_RECORDS / max(n, 1)))
    rows = keyed.where(F.pmod("h", F.lit(1_000_003)) < F.lit(share)).orderBy("h", "t").limit(FIT_RECORDS).select("t").toPandas()["t"]
    return fit(rows)


def residue(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, is_residue, log_odds) of every record.

    A null or empty text is no residue (it has no passages).  Whole texts are
    judged.  Repeated records are judged each; other columns are ignored.  The
    fitted model is a bounded table of words, the only thing sent to executors.
    """
    fitted = model or fit_corpus(docs, doc_id, text)

    def mark(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t, fitted) for t in texts], columns=["is_residue", "log_odds"])

    udf = F.pandas_udf(mark, "is_residue boolean, log_odds double")
    return docs.select(F.col(doc_id).alias("doc_id"), udf(F.col(text)).alias("j")).select("doc_id", "j.*")
