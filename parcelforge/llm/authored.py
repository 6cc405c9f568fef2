"""The text of an e-mail that its sender newly wrote.

A recursive layout grammar reads the lines of a body into a tree::

    message   := notice* part* ending?
    part      := text | quote
    quote     := intro? prefixed            (lines with one more ``>`` or ``|``, read as a message)
               | intro message              (an unmarked earlier message, to the end)
               | greeting message           (the same, after text or ending of the message itself)
    intro     := attribution | separator? header | separator
    ending    := (closing | delimiter | own name) (name | contact | device | notice)*

and only the text nodes at the top are serialised.  A line that merely looks like layout stays
text: a header line needs a name or address and a dated header line beside it, a closing has few
words, a prefixed line that begins with a number, without any quote around it, is a comparison.

Text that ends with what an earlier message of the thread newly said, unmarked, from its first line on, is cut there as well.  Null and blank bodies have no lines; a message delivered twice is
read once (the longest body, then the first in order); bodies cut off anywhere are read as far as they go.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.flexdate import instant_of
from parcelforge.runtime import cut, table

_PREFIX = re.compile(r"^(?:[ \t]?[>|])+[ \t]?")
_SEPARATOR = re.compile(r"^\s*(?:_{5,}|-{2,}\s*(?:original message|forwarded message|ursprüngliche nachricht|message d'origine|weitergeleitete nachricht|message transféré)\s*-{2,}|begin forwarded message\s*:)\s*$", re.I)
_RULE = re.compile(r"^\s*_{5,}\s*$")
# Header words of mail programs (English, German, French, Spanish, Italian, Dutch, Portuguese).
_FROM = re.compile(r"^\s*(?:from|von|de|da|van|expéditeur)\s?:\s*(\S.*)$", re.I)
_FIELD = re.compile(r"^\s*(?:sent|date|to|cc|bcc|subject|reply-to|gesendet|datum|an|betreff|envoyé(?: le)?|à|objet|enviado(?: el)?|para|asunto|inviato|a|oggetto|verzonden|aan|onderwerp|assunto)\s?:\s*(.*)$", re.I)
_DATED = re.compile(r"^\s*(?:sent|date|gesendet|datum|envoyé(?: le)?|enviado(?: el)?|inviato|verzonden)\s?:.*\d", re.I)
_WROTE = re.compile(
    r"^\s*(?:on\b.*\d.*\bwrote\s?:|.{1,80}\bwrote on\b.*\d.*:|le\b.*\d.*\ba écrit\s?:|am\b.*\d.*\bschrieb\b.*:|el\b.*\d.*\bescribió\s?:|il\b.*\d.*\bha scritto\s?:|op\b.*\d.*\bschreef\b.*:|em\b.*\d.*\bescreveu\s?:)\s*$",
    re.I | re.S,
)
_WROTE_START = re.compile(r"^\s*(?:on|le|am|el|il|op|em)\b.*\d", re.I)
# Closing words.
_CLOSING = re.compile(
    r"^\s*(?:(?:with )?(?:very )?(?:kind(?:est)?|best|warm(?:est)?|many)?\s*(?:regards|wishes)|kr|br|rgds|regards|best|all the best|cheers|(?:many |kind )?thanks(?: again)?|thank you|thx|ta|yours(?: (?:sincerely|faithfully|truly|ever))?|sincerely|speak soon|"
    r"mit freundlichen grüßen|viele grüße|cordialement|bien à vous|saludos|cordiali saluti|met vriendelijke groet)\s*[,.!]?\s*$",
    re.I,
)
_DELIMITER = re.compile(r"^\s*(?:--|—|_{2,4}|\*{3,})\s*$")
_DEVICE = re.compile(r"^\s*(?:sent (?:from|via|using|on) (?:my|the|a|mobile|outlook|mail|yahoo|gmail)\b.{0,60}|sent on the move\b.*|get (?:the|outlook|our)\b.{0,30}\b(?:app|for (?:ios|android|mobile))\b.*|von meinem .* gesendet|envoyé de mon .*)$", re.I)
_CONTACT = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+|\bwww\.|https?://|\b(?:t|m|w|e|p|d|ddi|tel|mob|mobile|phone|direct|fax)\b\s*[:.]?\s*\+?[\d(]|\b0\d{2,4}[ -]?\d{3,4}[ -]?\d{3,4}\b|\+\d{2}[ \d]{8,}", re.I)
# What notices say.
_NOTICE = re.compile(
    r"\bdisclaimer\b|\bconfidential(?:ity)?\b.*\b(?:intended|privileged|recipient|solely)\b|^\s*confidentiality\s*:|\b(?:e-?mail|message|communication)\b.*\b(?:confidential|privileged|intended (?:solely|only|for))\b|\bintended recipient\b|\bnotify (?:us|the sender)\b.*\bdelete\b|"
    r"\bmay be privileged\b|\baccept no (?:liability|responsibility)\b|\bunauthori[sz]ed (?:copying|use|disclosure)|\bsubject to contract and without prejudice\b|\bmisrepresentation\b|\bconsider the environment\b|\b(?:cyber )?fraud\b.*\b(?:alert|bank|details)\b|\bbank details will not change\b|"
    r"\bexternal (?:e-?mail|sender|message)\b|\boutside the organi[sz]ation\b|\bsender is new to you\b|\bdo not click\b|\bregistered (?:number|office|in|company)\b|\bregulated (?:surveyors|by)\b|\blimited liability partnership\b|\blist of members\b|\bopen to inspection at our registered\b|"
    r"\byou received this because\b|\bunsubscribe\b|\bto stop receiving\b|\breply with (?:remove|stop)\b|\bgeneral guide only\b|^\s*\[?external\]?\s*$|\bvirus(?:es)?\b.*\b(?:liab|scan|transmission)|\bscanned for viruses\b|\bright of reliance\b",
    re.I,
)
#: One of these stands in every notice.
_NOTICE_HINTS = (
    "disclaimer", "confidential", "privileged", "intended", "notify", "accept no", "unauthori", "subject to contract", "misrepresentation", "environment", "fraud", "bank details", "external",
    "outside the organi", "new to you", "do not click", "registered", "regulated", "limited liability", "list of members", "open to inspection", "you received", "unsubscribe", "stop receiving", "reply with", "general guide", "virus", "reliance",
)
_TITLE = re.compile(r"\b(?:director|partner|associate|surveyor|analyst|manager|head of|agency|investment|valuation|advisory|capital markets|consultant|assistant|graduate|senior|executive|chartered|commercial|estates|property|group|llp|ltd|limited|plc|& co|& sons|partners|surveyors|advisors|real estate|markets|management|asset)\b", re.I)
_GREETING = re.compile(r"^\s*(?:(?:hi|hello|dear|hey|good (?:morning|afternoon|evening|day)|morning|afternoon|evening)(?:[ ,]+[^\s.?:;]+){0,3}|all|team)\s*[,!]?\s*$", re.I)


@dataclass
class Node:
    """``kind``: message, text, quote, intro, closing, signature, device or notice; ``lines``: numbers from 1 of its own lines."""

    kind: str
    lines: list[int] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


def depth(line: str) -> int:
    m = _PREFIX.match(line)
    return sum(c in ">|" for c in m.group()) if m else 0


def strip_prefix(line: str) -> str:
    """A line without one quote mark."""
    return re.sub(r"^[ \t]?[>|][ \t]?", "", line, count=1)


_known: dict[str, bool] = {}


def is_notice(text: str) -> bool:
    """Whether a line says what notices say; a worker remembers the lines that might."""
    low = text.lower()
    if not any(h in low for h in _NOTICE_HINTS):
        return False
    got = _known.get(text)
    if got is None:
        if len(_known) > 50_000:
            _known.clear()
        got = _known[text] = bool(_NOTICE.search(text))
    return got


def is_name(text: str) -> bool:
    """One to four capitalised words, nothing else."""
    words = text.strip().strip(",").split()
    return 0 < len(words) <= 4 and all(re.match(r"^(?:[A-ZÀ-Þ][\w'’.-]*|&|de|van|von)$", w) for w in words) and not text.rstrip().endswith((".", "?", "!", ":"))


class Parser:
    """Reads (number, text) lines into a tree; ``sender`` is the header's ``Name <address>``."""

    def __init__(self, sender: str | None):
        name = re.sub(r"<[^>]*>", "", sender or "").strip().strip('"').lower()
        self.names = {name, name.split(" ")[0]} - {""}

    # --- terminals -------------------------------------------------------------------------------------------------------------------
    def intro(self, lines: list[tuple[int, str]], i: int) -> int:
        """How many lines from i on are the introduction of an earlier message; 0 if none."""
        text = lines[i][1]
        if _WROTE.match(text):
            return 1
        if _WROTE_START.match(text):
            for k in (1, 2):
                if i + k < len(lines) and lines[i + k][1].strip() and _WROTE.match(" ".join(x for _, x in lines[i : i + k + 1])):
                    return k + 1
                if i + k < len(lines) and depth(lines[i + k][1]):
                    break
        if i == len(lines) - 1 and (  # the text may break off in it
            re.match(r"^\s*(?:on|le|am)\b.*\d{1,2}[ ./-].*\d", text, re.I) and not text.rstrip().endswith(".") or re.search(r"\bwrote on\b[^.]*$", text)):
            return 1
        k = i
        separated = bool(_SEPARATOR.match(text))
        if separated:
            k += 1
            while k < len(lines) and not lines[k][1].strip():
                k += 1
        head = self.header(lines, k)
        if head:
            return k + head - i
        return 1 if separated and not _RULE.match(text) else 0

    @staticmethod
    def header(lines: list[tuple[int, str]], i: int) -> int:
        """How many lines from i on are a header block with sender and date."""
        if i >= len(lines) or not (m := _FROM.match(lines[i][1])):
            return 0
        who = m[1]
        if "@" not in who and not is_name(who):
            return 0
        k, dated = i + 1, False
        while k < len(lines) and (f := _FIELD.match(lines[k][1])) and not (f[1].endswith((".", "?")) and len(f[1].split()) > 4):
            dated = dated or bool(_DATED.match(lines[k][1]))
            k += 1
        return k - i if dated or k > i + 1 and "@" in who or k == len(lines) and "@" in who else 0

    def own_name(self, text: str) -> bool:
        return text.strip().strip(",").lower() in self.names

    @staticmethod
    def signs(text: str) -> bool:
        """Whether a line can stand in a signature: a name, a role, a firm, a way to reach someone."""
        s = text.strip()
        return bool(_CONTACT.search(s) or _DEVICE.match(s) or _DELIMITER.match(s) or is_notice(s) or is_name(s) or (len(s.split()) <= 8 and _TITLE.search(s) and not s.endswith((".", "?", "!"))) or s.count("|") >= 1)

    # --- rules -----------------------------------------------------------------------------------------------------------------------
    def message(self, lines: list[tuple[int, str]]) -> Node:
        out = Node("message")
        i, n, ending, introduced = 0, len(lines), False, False

        def add(kind: str, number: int) -> None:
            if not (out.children and out.children[-1].kind == kind and not out.children[-1].children):
                out.children.append(Node(kind))
            out.children[-1].lines.append(number)

        while i < n:
            number, text = lines[i]
            if not text.strip():
                i += 1
                continue
            if depth(text):
                j = i
                while j < n and (depth(lines[j][1]) or not lines[j][1].strip()):
                    j += 1
                while not lines[j - 1][1].strip():
                    j -= 1
                if self.comparison(lines, i, j, introduced):
                    add("text", number)
                    i += 1
                    continue
                inner = self.message([(k, strip_prefix(x)) for k, x in lines[i:j]])
                out.children.append(Node("quote", [k for k, _ in lines[i:j]], [inner]))
                i, ending = j, False
                continue
            k = self.intro(lines, i)
            if k:
                for m, x in lines[i : i + k]:
                    if x.strip():
                        add("intro", m)
                i += k
                while i < n and not lines[i][1].strip():
                    i += 1
                introduced = True
                if i < n and not depth(lines[i][1]):
                    out.children.append(Node("quote", [m for m, _ in lines[i:]], [self.message(lines[i:])]))
                    return out
                ending = False
                continue
            kind = self.plain(lines, i, ending)
            if kind == "text" and _GREETING.match(text) and (ending or any(c.kind == "text" for c in out.children)):
                # a second greeting opens an earlier message that stands there unmarked
                out.children.append(Node("quote", [m for m, _ in lines[i:]], [self.message(lines[i:])]))
                return out
            if kind in ("closing", "signature"):
                ending = True
            add(kind, number)
            i += 1
        return out

    def comparison(self, lines, i: int, j: int, introduced: bool) -> bool:
        """A lone marked line that begins with a number and stands in running text: ``> 7 % would do``."""
        if depth(lines[i][1]) != 1 or not re.match(r"^[>]\s*[£€$]?\d", lines[i][1].strip()):
            return False
        return j == i + 1 and (not introduced or (i > 0 and lines[i - 1][1].strip() and not depth(lines[i - 1][1])))

    def plain(self, lines, i: int, ending: bool) -> str:
        text = lines[i][1]
        if _DEVICE.match(text):
            return "device"
        if is_notice(text) and not self.authored_look(text):
            return "notice"
        if _CLOSING.match(text):
            return "closing"
        if _DELIMITER.match(text):
            return "signature"
        if self.own_name(text):
            return "signature"
        if _GREETING.match(text):
            return "text"
        if ending:
            return "signature" if self.signs(text) or not self.sentence(text) else "text"
        if self.starts_signature(lines, i):
            return "signature"
        return "text"

    @staticmethod
    def authored_look(text: str) -> bool:
        """Sentences of ordinary business that only mention a notice's words."""
        return bool(re.search(r"\b(?:this|the) (?:schedule|brochure|list|draft|report)\b.*\bconfidential until\b|\bplease (?:treat|keep)\b.*\bconfidential\b", text, re.I))

    @staticmethod
    def sentence(text: str) -> bool:
        s = text.strip()
        words = s.split()
        return bool(_GREETING.match(s)) or (len(words) >= 4 and any(w[0].islower() for w in words if w) and (s.endswith((".", "?", "!", ":")) or len(words) >= 6))

    def starts_signature(self, lines, i: int) -> bool:
        """A name (of whoever signs) with nothing but signature lines, or nothing, after it up to a blank line, a quote or the end."""
        text = lines[i][1].strip()
        if " | " in text and (_CONTACT.search(text) or is_name(text.split(" | ")[0]) and _TITLE.search(text)):
            return True
        if not is_name(text) or _GREETING.match(text):
            return False
        k = i + 1
        while k < len(lines) and lines[k][1].strip() and not depth(lines[k][1]):
            if not self.signs(lines[k][1]):
                return False
            k += 1
        return k > i + 1 or not self.names or len(text.split()) <= 2


def tree(body: str | None, sender: str | None) -> Node:
    lines = [(k, x.rstrip("\r")) for k, x in enumerate((body or "").split("\n"), 1)]
    return Parser(sender).message(lines)


def new_lines(body: str | None, sender: str | None) -> list[int]:
    """Numbers of the lines that are newly written."""
    return [k for c in tree(body, sender).children if c.kind == "text" for k in c.lines]


def one_copy(mails: DataFrame) -> DataFrame:
    """Each message once, with its longest body."""
    of = F.struct(F.coalesce(F.length("body_preview"), F.lit(-1)).alias("n"), "body_preview", "sender", "thread_id", "date")
    best = mails.where("trim(gmail_message_id) <> ''").groupBy("gmail_message_id").agg(F.max(of).alias("m"))
    return best.select("gmail_message_id", "m.body_preview", "m.sender", F.when(F.trim("m.thread_id") != "", F.col("m.thread_id")).alias("thread_id"), "m.date")


def authored(mails: DataFrame) -> DataFrame:
    """(gmail_message_id, lines): the newly written lines (no, line) of every message that has any."""

    def run(batches):
        for b in batches:
            out = []
            for mid, body, sender, thread, date in zip(*(b.column(i).to_pylist() for i in range(5))):
                lines = (body or "").split("\n")
                got = [{"no": k, "line": lines[k - 1].strip()} for k in new_lines(body, sender)]
                if got:
                    out.append((mid, thread, instant_of(date), got))
            cols = list(zip(*out)) if out else [()] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("no", pa.int64()), ("line", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["gmail_message_id", "thread_id", "at", "lines"])

    parsed = cut(one_copy(mails).mapInArrow(run, "gmail_message_id string, thread_id string, at string, lines array<struct<no: bigint, line: string>>"))
    start = F.xxhash64("thread_id", F.col("lines")[0]["line"], F.coalesce(F.try_element_at(F.col("lines"), F.lit(2))["line"], F.lit("")))
    known = parsed.where("thread_id is not null and at is not null").select(start.alias("key"), "at", "gmail_message_id", "lines")
    first = known.groupBy("key").agg(F.min_by(F.struct("at", F.col("gmail_message_id").alias("by"), F.col("lines.line").alias("said")), F.struct("at", "gmail_message_id")).alias("f"))
    asked = parsed.where("thread_id is not null and at is not null and size(lines) > 1")
    # line and following line of each place, without the text around them
    after = F.zip_with("lines", F.slice(F.col("lines"), F.lit(2), F.size("lines")), lambda x, y: F.struct(x["no"].alias("no"), x["line"].alias("line"), F.coalesce(y["line"], F.lit("")).alias("then")))
    asked = asked.select("gmail_message_id", "thread_id", "at", F.posexplode(after).alias("pos", "x")).where("pos > 0 and x.no is not null")
    asked = asked.select("gmail_message_id", "at", "pos", F.col("x.no").alias("no"), F.xxhash64("thread_id", "x.line", "x.then").alias("key"))
    met = asked.join(first, "key").where(F.col("f.at") < F.col("at")).select("gmail_message_id", "pos", "no", F.col("f.said").alias("said"))
    rest = F.slice(F.col("lines.line"), F.col("pos") + 1, F.size("lines"))
    met = met.join(parsed.select("gmail_message_id", "lines"), "gmail_message_id").select("gmail_message_id", "no", rest.alias("rest"), "said")
    pairs = F.zip_with("rest", F.slice(F.col("said"), F.lit(1), F.size("rest")), lambda a, b: F.coalesce(b.startswith(a), F.lit(False)))
    # the rest of the message, to its end, is what the earlier one said from its start
    again = met.where(F.forall(pairs, lambda x: x)).where("size(rest) > 1 or size(said) = 1")
    cuts = again.groupBy("gmail_message_id").agg(F.min("no").alias("from_no"))
    out = parsed.join(cuts, "gmail_message_id", "left")
    return out.select("gmail_message_id", F.filter("lines", lambda x: F.coalesce(x["no"] < F.col("from_no"), F.lit(True))).alias("lines"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    """The newly written lines of every message."""
    return authored(table(spark, sf_dir, "email_summaries")).select("gmail_message_id", F.explode("lines.no").alias("line_no"))


def p6_texts(spark, sf_dir: str) -> DataFrame:
    """One row per message with new lines: its newly written text."""
    return authored(table(spark, sf_dir, "email_summaries")).select("gmail_message_id", F.array_join(F.col("lines.line"), "\n").alias("text"))
