"""Text operators: pure functions first, then their columns over awkward rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import markup, pii, residue

AWKWARD = [(1, None, "x"), (2, "", "x"), (3, "   \n\t", "x"), (4, "word " * 60_000, "x"), (5, "a\x00b \ud83d" .encode("utf-16", "surrogatepass").decode("utf-16", "replace"), "x")]

# --- markup
@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("plain words, 5 * 3 * 2 and a < b, x <> y, R & D, $5 or $7, C# and 2^10", []),
        ("I pass a List<int> or a Map<K, V>; data/in_*/part_*.csv and my_file_name; arr[0][1], arr[[0]]; item [3]", []),
        ("- one\n* two\n3. three", []),
        ("<p>one</p>", ["html"]), ("a &lt; b", ["html"]), ("don&#x27;t", ["html"]), ("<PRE>x *y* z</PRE>", ["html"]),
        ("# Head", ["markdown"]), ("Head\n====", ["markdown"]), ("a **b** c", ["markdown"]), ("a __b__ c", ["markdown"]), ("use `x`", ["markdown"]), ("```\n<p>\n```", ["markdown"]),
        ("[a](http://b)", ["markdown"]), ("![a](b.png)", ["markdown"]), ("[a][1]\n\n[1]: http://b", ["markdown"]), ("> quoted", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]),
        ("== Head ==", ["wiki"]), ("a '''b''' c", ["wiki"]), ("a ''b'' c", ["wiki"]), ("[[Page|label]]", ["wiki"]), ("[[File:a.png|thumb|b]]", ["wiki"]), ("{{code|x}}", ["wiki"]), ("{| class=\"t\"\n|-\n| a || b\n|}", ["wiki"]),
        ("<syntaxhighlight lang=\"python\">\na < b\n</syntaxhighlight>", ["wiki"]), ("<nowiki>'''x''' <b></nowiki>", ["wiki"]), ("See [https://a.b/c the page].", ["wiki"]),
        ("\\section{A}", ["latex"]), ("$x_i^2$", ["latex"]), ("$$\na = b\n$$", ["latex"]), ("\\(O(n)\\)", ["latex"]), ("\\begin{verbatim}\n# no\n\\end{verbatim}", ["latex"]), ("use \\texttt{x}", ["latex"]),
        ("<p>use `x` and $A^{-1} b$</p>", ["html", "latex", "markdown"]),
    ],
)
def test_markup_kinds(text, kinds):
    assert markup.analyse(text)[1] == kinds

def test_clean_text_keeps_structure():
    html = "<h2>Setup</h2><p>Use <code>a &lt; b</code> &amp; wait</p><ul><li>one</li><li>two</li></ul><pre><code>x = 1\ny = 2\n</code></pre><p>\\(a^2\\)</p>"

    clean = markup.analyse(html)[0]
    assert all(x in clean for x in ("## Setup", "`a < b` & wait", "- one", "- two", "```\nx = 1\ny = 2\n```", "$a^2$")) and "<" not in clean.replace("a < b", "")
    assert markup.analyse("\\begin{equation} E = \\frac{a}{b} + \\alpha x \\end{equation}")[0] == "$$E = \\frac{a}{b} + \\alpha x$$"
    assert markup.analyse("So \\alpha \\leq \\beta holds")[0] == "So $\\alpha \\leq \\beta$ holds"
    assert markup.analyse("{{note|Do not run this}} now")[0] == "Do not run this now" and markup.analyse("{{Reflist}} end")[0] == "end"
    assert markup.analyse("<ol><li>a</li><li>b<ul><li>c</li></ul></li></ol><ul><li>d</li></ul>")[0].split("\n") == ["1. a", "2. b", "- c", "- d"]
    assert markup.analyse("\\begin{enumerate}\n\\item a\n\\item b\n\\end{enumerate}\n\\begin{itemize}\n\\item c\n\\end{itemize}")[0].split() == ["1.", "a", "2.", "b", "-", "c"]
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    assert markup.analyse(table)[0] == table
    assert markup.analyse("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>")[0] == "1 | 2\n3 | 4"
    assert markup.analyse("\\begin{tabular}{ll} a & b \\\\ c & d \\end{tabular}")[0] == "a | b\nc | d"
    assert markup.analyse("{| class=\"t\"\n! x !! y\n|-\n| 1 || 2\n|}")[0] == "| x | y\n| 1 | 2"
    assert markup.analyse("see \\cite{knuth} and \\url{http://a.b}")[0] == "see knuth and http://a.b"
    assert markup.analyse("== A ==\n'''b''' and [[C|d]]\n\\emph{e}")[0] == "## A\nb and d\ne"

def test_navigation_lines_are_left_out():
    nav = "<div>" + "".join(f'<a href="/{i}">l{i}</a>' for i in range(30)) + "</div>"
    text = "".join(f"<p>{'real words in a long paragraph ' * 8}{i}</p>" for i in range(6))
    clean = markup.analyse(nav + text)[0]
    assert "l29" not in clean and clean.count("paragraph") == 48
    # the same rows in other notations; a link that stands alone, or in a list, is content
    for row in (" | ".join(f"[l{i}](/{i})" for i in range(30)), " · ".join(f"[[P{i}|l{i}]]" for i in range(30))):
        long = "\n".join("real words in a long paragraph " * 8 for _ in range(6))
        clean = markup.analyse(f"{row}\n\n{long}\n\n[the docs](http://a.b)\n\n- [one](x)\n- [two](y)")[0]
        assert "l29" not in clean and clean.count("paragraph") == 48 and all(x in clean for x in ("the docs", "- one", "- two"))
    assert markup.analyse("See [this page](x) and [that](y).")[0] == "See this page and that."

@pytest.mark.parametrize("unit", ["<pre>x ", "<code>x ", "\\begin{verbatim} x ", "\\begin{equation} x ", "\\[ x ", "**a ", "''a ", "&a ", "<script>a ", "[[a ", "$a "])
def test_long_texts_of_openings_take_no_longer_than_their_length(unit):
    import time

    text = unit * (200_000 // len(unit))
    began = time.perf_counter()
    clean, kinds = markup.analyse(text)
    residue.judge(text, residue.NOTHING)
    pii.redact_text(text, KEY)
    assert time.perf_counter() - began < 15 and isinstance(clean, str)
    # an opening that is closed is still found behind many that are not, and the other way round
    closed = unit * 2000 + "\n<pre>y</pre>\n" + unit * 2000
    assert "```\ny\n```" in markup.analyse(closed)[0] or unit.startswith(("<pre", "<code", "<script"))

def test_broken_markup_is_plain_text():
    rng = random.Random(2)
    for _ in range(300):
        s = "".join(rng.choice(["<", ">", "&", ";", "`", "*", "_", "$", "\\", "{", "}", "[", "]", "=", "'", "a", " ", "\n", "<p>", "</pre>", "\\begin{"]) for _ in range(40))
        clean, kinds = markup.analyse(s)
        assert isinstance(clean, str) and set(kinds) <= {"html", "markdown", "wiki", "latex"}

@pytest.mark.parametrize("tag", ["<script>", "<style>", "<SCRIPT>", '<script src="x">'])
def test_unclosed_script_is_plain_text(tag):
    assert markup.analyse(f"How do I put a {tag} tag in the head?\nIt has <b>no</b> effect &amp; **fails**") == (f"How do I put a {tag} tag in the head?\nIt has no effect & fails", ["html", "markdown"])
    assert markup.analyse(f"Why is {tag} blocked") == (f"Why is {tag} blocked", [])

def test_closed_script_is_left_out():
    assert markup.analyse("one <script>if (a < b) { <p> }</script> two <style>\np {}\n</STYLE > three") == ("one  two  three", ["html"])
    assert markup.analyse("one <script>x</script> two <script> three") == ("one  two <script> three", ["html"])
    assert markup.analyse('one <script src="x"/> two <script>x</script> three') == ("one  two  three", ["html"])

# --- personal information
KEY = b"k"

@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("mail jo.doe@mail.example.org.", ["email"]), ("jo at uni dot test", ["email"]), ("jo(at)example.net", ["email"]), ("jo [at] example [dot] com", ["email"]), ("mailto:jo+x@corp.example.com", ["email"]),
        ("pkg lot@1.10.4, item@stock.T and berth@stn.values", []), ("git@host.example:repo", []),
        ("call (415) 555.0195 ext. 12", ["phone"]), ("+1 (617) 555-0111", ["phone"]), ("0014155550109", ["phone"]), ("+49 30 23125 158", ["phone"]), ("07700 900361", ["phone"]), ("020 7946 0039", ["phone"]),
        ("build 0.16.5.15, epoch 1689283961440, range 226429-1015015-19, serial 02666-47083, 2024-11-20 15:14:39", []), ("id 12ef4801-cf6f-4c77-a07f-53046fe1688f trace 0efad05f9d577c00", []),
        ("SSN 666-10-9004", ["id_number"]), ("passport: QQ317888", ["id_number"]), ("driver licence ZZ51-39319", ["id_number"]), ("NI number QQ 99 29 89 Z", ["id_number"]), ("tax id 98-7638971", ["id_number"]), ("request id was 12345678", []),
        ("Flat 3, 98 Saltbridge Court, Melbury.", ["street_address"]), ("114 Old Cooper Street, Apt 41, Grenvik 75946", ["street_address"]), ("Muehlenstraße 78, 01970 Melbury", ["street_address"]),
        ("10 rue des Cordiers, Tarnhausen", ["street_address"]), ("Calle del Faro 252, Port Sillow", ["street_address"]), ("There are 221 Street segments; column 11 of 12 Drive sheets", []),
        ("Hi all, Bruno Falkenmoor here", ["person_name"]), ("by Dr. T. Silverstrand", ["person_name"]), ("Assigned to: Ferrantello, Oona", ["person_name"]), ("ZOFIA GRIMSHOLT", ["person_name"]), ("Thanks, Nadia", []),
        ("A Monte Carlo run with Random Forest in Power BI and Google Sheets", []), ("Greetings from Larkspur Street", []),
    ],
)
def test_mentions(text, kinds):
    assert [k for _, _, k in pii.find(text)] == kinds

@pytest.mark.parametrize("text", ["My colleague A. Ferrantello wrote", "Regards\nI. Kestrelby", "I owe this idea to I. Falkenmoor", "the script of A. Oyelundo"])
def test_initials_that_are_words(text):
    assert [k for _, _, k in pii.find(text)] == ["person_name"]

def test_cheap_test_never_rules_out_a_name():
    rng = random.Random(4)
    words = ["A.", "I.", "A", "I", "B.", "The", "Hello", "Regards", "Dr.", "Ferrantello", "Oona", "Oona,", "O'Brien", "ZOFIA", "Street", "will", "wrote", "d’Arc", "I'm", "Anna-Maria"]
    for _ in range(3000):
        s = "".join(rng.choice(words) + rng.choice([" ", " ", "\n", ", ", ". "]) for _ in range(rng.randint(2, 4)))
        assert pii.find(s) == pii.find(s, cheap=False), s

@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("write x { at } y.com", "email"), ("write x [ AT ] y.com", "email"), ("write x(At)y.com", "email"), ("jo at uni Dot test", "email"), ("jo at uni\ndot\ntest", "email"), ("x&COMMAT;y.com", "email"),
        ("my NI no QQ992989", "id_number"), ("policy holder 12345678", "id_number"), ("drİver lİcence 51393190", "id_number"), ("ring (020)79460958", "phone"),
        ("at 12bis rue Morel", "street_address"), ("at 12 bis, rue Morel", "street_address"), ("at 12 ter rue Morel", "street_address"),
    ],
)
def test_mentions_however_spelt(text, kind):
    assert [k for _, _, k in pii.find(text)] == [kind]

def sample(tree, rng):
    """A text of the form of a parsed pattern; what stands around it is not looked at."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            kind, x = rng.choice(arg)
            out += chr(x) if str(kind) == "LITERAL" else chr(rng.randint(*x)) if str(kind) == "RANGE" else {"CATEGORY_DIGIT": "7", "CATEGORY_SPACE": rng.choice(" \n")}.get(str(x), "k")
        elif op == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif op == "SUBPATTERN":
            out += sample(arg[3], rng)
        elif op == "MAX_REPEAT":
            out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
    return out

@pytest.mark.parametrize("pattern", [pii.EMAIL, pii.ADDRESS, pii.ID_NUMBER, pii.SSN, pii.PHONE, pii.DATE, pii.NAME])
def test_cheap_tests_are_implied_by_their_patterns(pattern):
    rng, hits = random.Random(8), 0
    tree = re._parser.parse(pattern.pattern, pattern.flags)
    for _ in range(4000):
        s = sample(tree, rng)
        s = rng.choice([s, s.upper(), s.title()]) if pattern.flags & re.IGNORECASE else s
        hits += pattern.search(s) is not None
        assert pii.find(s) == pii.find(s, cheap=False), s
    assert hits > 200

def test_redaction_changes_nothing_else_and_links_equal_values():
    text = "Ask Oona Ferrantello (oona@example.org), SSN 666-10-9004, or OONA FERRANTELLO again; x = 5."
    out = pii.redact_text(text, KEY)
    assert re.sub(r"\[(EMAIL|NAME|ID) [^\]]+\]", "¤", out) == "Ask ¤ (¤), SSN ¤, or ¤ again; x = 5."
    names = re.findall(r"\[NAME (\w+)\]", out)
    assert names[0] == names[1] and "oona" not in out.lower()
    assert pii.redact_text("nothing here", KEY) == "nothing here"
    digits = lambda v: re.sub(r"\D", "", pii.placeholder("phone", v, KEY))[-10:]
    assert len({digits(v) for v in ("+1 415 555 0101", "+1 (415) 555-0101", "415.555.0101", "0014155550101", "1-415-555-0101")}) == 1
    assert digits("+44 20 7946 0039") == digits("020 7946 0039") != digits("+44 20 7946 0038")
    assert re.fullmatch(r"\[PHONE \+1 \(\d{3}\) \d{3}-\d{4} ext\. \d\d\]", pii.placeholder("phone", "+1 (415) 555-0101 ext. 12", KEY))
    assert len(re.search(r"\[NAME (\w+)\]", out)[1]) == 32

@pytest.mark.parametrize("born", ["1980-03-12", "12 March 1980", "March 12, 1980", "12/03/1980", "12.03.1980", "Mar 12 1980"])
def test_birth_dates_of_many_forms_are_one_day(born):
    out = pii.redact_text(f"born {born}, x", KEY)
    assert born not in out and out.endswith(", x")
    turned = re.search(r"\[DATE ([^\]]+)\]", out)[1]
    assert pii._date(turned) == pii._date(pii.pseudonym_date("1980-03-12", KEY)) and pii._date(pii.pseudonym_date(turned, KEY, back=True)) == pii._date("1980-03-12")

def test_feistel_is_a_permutation_that_can_be_undone():
    assert sorted(pii.feistel(f"{i:03d}", KEY) for i in range(1000)) == [f"{i:03d}" for i in range(1000)]
    for v in ("12", "0123456789", "415-555-0101", "QQ317888"):
        turned = pii.pseudonym_number(v, KEY)
        assert re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", turned)) == re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", v)) and pii.pseudonym_number(turned, KEY, back=True) == v
    for d in ("1984-02-29", "1900-01-01", "2099-12-31"):
        assert pii.pseudonym_date(pii.pseudonym_date(d, KEY), KEY, back=True) == d
    assert pii.feistel("123456", b"other") != pii.feistel("123456", KEY)

# --- residue
RESIDUE = ["Hello {{ name }}, your question {{ link }} has {{ n }} new answers.", "404 Not Found\nThe page you asked for is not here.", "Lorem ipsum dolor sit amet. Magna nulla vitae tempus nibh.", "asdf asdf asdf asdf asdf", "Please enable JavaScript to continue."]
REAL = ["My template has {{a}} in the header and {{ b }} in the loop, but only the first one is filled when I run it.", 'When I scrape the page all I get is "Please enable JavaScript to continue." instead of the table.', "The job reads all files of the day and writes them to a table, which takes long.", "Which version is this?"]

def corpus(rng):
    """Varied real posts, and pages stamped from templates with navigation around some of them."""
    who, what, why = ["the job", "my query", "this notebook", "our writer", "the reader", "one task"], ["drops", "reads", "sorts", "repeats", "renames", "groups", "casts"], ["null keys", "late rows", "the first column", "old files", "two partitions", "date values", "every index"]
    posts = [" ".join(f"{rng.choice(who)} {rng.choice(what)} {rng.choice(why)} after {rng.randint(2, 99)} minutes, this is on your page, and I do not know how to stop {rng.choice(who)}.".capitalize() for _ in range(rng.randint(1, 6))) for _ in range(1500)]
    posts += [f"Which version of {rng.choice(why)} is {rng.choice(['this', 'that', 'yours'])}?" if i % 2 else f"Did you try to look at {rng.choice(why)}, and does {rng.choice(who)} run? It is what this is for." for i in range(200)]
    rng.shuffle(posts)
    pages = ["This page needs scripts to be turned on in your browser.", "JavaScript is disabled. Activate it and reload the page.", "The connection to the upstream server timed out after 7 seconds.", "Access denied. You do not have permission to view this page.", *RESIDUE]
    stamped = [rng.choice(["", "Home | Questions | Tags | Users\n"]) + p for p in pages for _ in range(14)]
    return posts, stamped

def test_residue_of_templates_kept_out_of_the_seeds():
    rng = random.Random(3)
    posts, stamped = corpus(rng)
    held = re.compile(r"script|upstream|permission", re.IGNORECASE)
    model = residue.fit(posts[:1200] + stamped + REAL, seeds=lambda p, f: residue.trusted(p, f) and not held.search(p))
    unseeded = [t for t in stamped if held.search(t)]
    assert len(unseeded) > 50 and sum(residue.judge(t, model)[0] for t in unseeded) >= 0.9 * len(unseeded)
    assert all(residue.judge(t, model)[0] for t in stamped if not held.search(t))
    assert not any(residue.judge(t, model)[0] for t in REAL + posts[1200:])
    # a page beside real content is no case, a trusted passage beside a mild one is
    assert not any(residue.judge(p + "\n" + t, model)[0] for p in RESIDUE for t in posts[:20])
    assert residue.judge("Menu Search Help\nHi ${user}, thank you for visiting ${site}.", model)[0]
    assert residue.judge(None, model)[0] is residue.judge("", model)[0] is residue.judge("Home | Tags", model)[0] is False

def test_without_trusted_passages_nothing_is_residue():
    model = residue.fit(REAL)
    assert model == residue.NOTHING == residue.fit([]) and not any(residue.judge(t, model)[0] for t in REAL + RESIDUE)

# --- as columns
def test_columns_over_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id bigint, text string, markup string")
    got = df.select("doc_id", markup.analysed(F.col("text")).alias("m"), pii.redacted(F.col("text"), "k")["mentions"].alias("p"), pii.redacted(F.col("text"), "k")["text"].alias("r")).orderBy("doc_id").collect()
    assert got[0].m.clean is None and got[0].r is None and got[1].r == "" and all(r.m.markup == [] and r.p == [] for r in got)
    assert len(got[3].r) == 300_000
    judged = residue.residue(df, model=residue.NOTHING)
    assert [r.is_residue for r in judged.orderBy("doc_id").collect()][:3] == [False] * 3
    assert residue.residue(df.limit(0)).count() == 0
    repeated = pii.mentions(spark.createDataFrame([("h", "a@b.co and c@d.co"), ("h", "a@b.co and c@d.co")], "key string, t string"), ["key"], "t", "k")
    assert sorted(tuple(r)[:3] for r in repeated.collect()) == [("h", "email", 1), ("h", "email", 2)]
    posts = spark.createDataFrame([("a", "call +1 415 555 0101"), ("b", "or 415.555.0101, 415-555-0101; a@b.co"), ("c", None)], "key string, t string")
    links = {(r.pii_type, r.posts, r.mentions) for r in pii.linked(pii.mentions(posts, ["key"], "t", "k"), ["key"]).collect()}
    assert links == {("phone", 2, 3), ("email", 1, 1)}
