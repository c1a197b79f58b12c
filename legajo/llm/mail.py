"""Problem 3: keep only what the sender of an e-mail newly wrote."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.session import discard, materialize, text_batches

NEW, QUOTED, SIGNATURE, DISCLAIMER, HEADER = range(5)
LABELS = ("new", "quoted", "signature", "disclaimer", "header")

#: Names of message header fields, fixed values.
FIELDS = r"(?:De|From|Para|To|A|CC|Cc|CCO|Cco|BCC|Bcc|Fecha|Date|Data|Enviado(?: el)?|Sent|Enviat|Asunto|Subject|Assumpte|Per a|Reply-To|Responder a|Importancia|Importance|Adjuntos|Attachments)"
HEADER_START = rf"^{FIELDS} ?: ?\S"
_FIELD = re.compile(rf"^{FIELDS} ?:(?: |$)")
_QUOTE = re.compile(r"^ ?[>|]")
_INDENT = re.compile(r"^(?:\t| {3,})\S")
_DASHES = re.compile(r"^--\s*$")
_RULE = re.compile(r"^ *(?:[-_*=~—–]{2,}|—)\s*$")
_FORWARD = re.compile(
    r"^\W*(?:-{2,}|_{2,}) ?(?:mensaje original|mensaje reenviado|original message|forwarded message|missatge original|missatge reenviat)\b.*$"
    r"|^(?:begin forwarded message|inicio del mensaje reenviado|inici del missatge reenviat|mensaje original|original message|missatge original)\s*:\s*$", re.I)
_WROTE = re.compile(r"(?:escribi\S{1,8}|wrote|va escriure(?: el .{4,30})?|ha escrit|escrigu\S{1,6}) ?:\s*$", re.I)
_INTRO = re.compile(r"^(?:El (?:\w+, )?\d{1,2} de \w+ de \d{4}\b|El \S+,? \d|On \w+,? \d|A les? \d|El dia \d)", re.I)
_CLOSING = re.compile(
    r"^(?:(?:un|muchos|muchas|mil)?\s*(?:cordial(?:es)? )?(?:saludos?|abrazos?|gracias)(?: y saludos?| cordial(?:es)?| de antemano)?"
    r"|atentamente|atte\.?|cordialmente|quedo a la espera(?:, un saludo)?|saludos cordiales|best(?: regards)?|kind regards|regards|sincerely(?: yours)?|many thanks|thanks(?: and regards)?|cheers"
    r"|salutacions(?: cordials)?|atentament|cordialment|una abra\S{1,4}ada|gr\S{1,4}cies)\s*[,.!]?\s*$", re.I)
_DEVICE = re.compile(r"^(?:enviado desde (?:mi|el)|sent from my|enviat des d|obtener la app|get (?:the )?\w+ (?:app|for)|descarga la app)", re.I)
_CONTACT = re.compile(r"\btel\.? ?[+\d]|\bext\. ?\d|^(?:www\.|https?://)\S+\s*$|^\S+@\S+\s*$|^(?:tel|m\S{1,4}vil|fax|mobile|phone)\.?:? ?[+\d]", re.I)
_NOTICE = re.compile(
    r"^(?:aviso legal|av\S{1,4}s legal|confidentiality notice|legal notice|disclaimer|este (?:correo|mensaje)(?: electr\S{1,6}nico)? (?:es confidencial|y sus adjuntos|puede contener|va dirigido)"
    r"|this (?:e-?mail|message) (?:is (?:intended|confidential)|and any|may contain)|en cumplimiento de la (?:normativa|ley)|antes de imprimir este|please consider the environment|before printing"
    r"|de conformidad con (?:la normativa|lo dispuesto)|aquest (?:correu|missatge) .{0,30}confidencial|abans d'imprimir|protecci\S{1,6}n de datos:|la informaci\S{1,6}n contenida en este)", re.I)
_PS = re.compile(r"^(?:P\.? ?[DS]\.?:? |P\.? ?[DS]\.?:|Posdata\b|Postdata\b|Post scriptum\b)")
_GREETING = re.compile(r"^(?:hola|hi|hello|dear|buen[oa]s|estimad[oa]s?|querid[oa]s?|bon dia|bona tarda|benvol|apreciad)\b", re.I)

KINDS = ("text", "short", "greeting", "field", "quote", "rule", "forward", "wrote", "intro", "address", "closing", "name", "contact", "device", "notice", "post", "indent", "dashes")
KIND = {k: i for i, k in enumerate(KINDS)}
#: What a line ends with.
ENDS = ("stop", "comma", "colon", "mark", "long", "brief")

#: Hidden states of the model and the label each stands for. A quotation that every line carries a mark of goes on
#: differently from an earlier message that runs on to the end; a notice and an earlier message have a first part by which they are known.
STATES = ("head", "new", "quotation", "earlier", "earlier text", "signature", "notice", "notice text")
STATE_LABEL = (HEADER, NEW, QUOTED, QUOTED, QUOTED, SIGNATURE, DISCLAIMER, DISCLAIMER)
HEAD, BODY, QUOTATION, EARLIER, EARLIER_TEXT, SIGN, NOTE, NOTE_TEXT = range(8)
#: Kinds that a state is expected to show more of, and steps from state to state, before anything is learned; a step of 0 is never taken.
#: The states in OPEN may show any kind, the others only what they are expected to.
EXPECTED = {
    HEAD: ("field",), BODY: ("text", "greeting", "post"), QUOTATION: ("quote", "indent", "wrote", "intro", "address"),
    EARLIER: ("forward", "field", "rule"), EARLIER_TEXT: ("text", "greeting", "quote", "closing", "name", "short"),
    SIGN: ("closing", "name", "contact", "device", "short", "dashes", "rule"), NOTE: ("notice", "rule"), NOTE_TEXT: ("text", "short", "contact", "indent"),
}
OPEN = (BODY, QUOTATION, EARLIER_TEXT, SIGN)
FIRST_STEPS = (
    (0.60, 0.30, 0.07, 0.01, 0.00, 0.01, 0.01, 0.00),
    (0.00, 0.84, 0.05, 0.03, 0.00, 0.06, 0.02, 0.00),
    (0.00, 0.15, 0.80, 0.01, 0.00, 0.02, 0.02, 0.00),
    (0.00, 0.00, 0.00, 0.60, 0.40, 0.00, 0.00, 0.00),
    (0.00, 0.00, 0.00, 0.02, 0.97, 0.00, 0.01, 0.00),
    (0.00, 0.03, 0.05, 0.05, 0.00, 0.82, 0.05, 0.00),
    (0.00, 0.01, 0.05, 0.05, 0.00, 0.03, 0.26, 0.60),
    (0.00, 0.01, 0.05, 0.05, 0.00, 0.03, 0.06, 0.80),
)
#: Share of the expectation in the learned model; rounds of learning; e-mails that the model learns from at most.
ANCHOR = 0.3
ROUNDS = 6
MAX_EMAILS = 20_000


def sender_names(first: str) -> set[str]:
    """Ways in which the sender of a first header line may sign: as typed, the given name, name and one surname."""
    name = re.sub(r"<.*?>|\(.*?\)|\S+@\S+", "", first.split(":", 1)[-1]).strip(" \"'\t")
    t = name.replace(",", " ").split()
    out = {name, " ".join(t[:1]), " ".join(t[:2]), " ".join(t[:3])} if t else set()
    if "," in name:
        a, b = name.split(",", 1)
        out |= {b.strip(), f"{b.strip()} {a.strip()}"}
    if t and t[0].endswith((".", "/a.")):
        out |= {" ".join(t[1:]), " ".join(t[1:2])}
    return {x.lower() for x in out if x}


def line_kind(line: str, names: set[str]) -> int:
    """The kind of one non-blank line by its own prefix, punctuation and words."""
    s = line.strip()
    if _QUOTE.match(line):
        return KIND["quote"]
    if _DASHES.match(line):
        return KIND["dashes"]
    if _RULE.match(line):
        return KIND["rule"]
    if _FORWARD.match(s):
        return KIND["forward"]
    if _FIELD.match(line):
        return KIND["field"]
    if _PS.match(s):
        return KIND["post"]
    if len(s) < 140 and _WROTE.search(s) and "«" not in s:
        return KIND["wrote"]
    if _INTRO.match(s) and s.endswith(","):
        return KIND["intro"]
    if len(s) < 300 and re.search(r"<\S+@\S+>$", s):
        return KIND["address"]
    if _CLOSING.match(s):
        return KIND["closing"]
    if s.lower() in names or s.lower().rstrip(".") in names:
        return KIND["name"]
    if _DEVICE.match(s):
        return KIND["device"]
    if _NOTICE.match(s):
        return KIND["notice"]
    if len(s) < 70 and _CONTACT.search(s):
        return KIND["contact"]
    if _GREETING.match(s) and len(s) < 60:
        return KIND["greeting"]
    if len(s.split()) <= 5 and len(s) < 45 and s[-1] not in ".,;:!?»)" and s[0].isupper():
        return KIND["short"]
    return KIND["indent" if _INDENT.match(line) else "text"]


def line_end(line: str) -> int:
    """What a line ends with: a full stop, a comma, a colon, another sign, or a letter of a long or a brief line."""
    s = line.rstrip()
    k = {".": "stop", ",": "comma", ":": "colon"}.get(s[-1]) or ("mark" if not s[-1].isalnum() else "brief" if len(s) < 45 else "long")
    return ENDS.index(k)


class Mail:
    """The non-blank lines of an e-mail with what the model sees of them."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        names = sender_names(next((x for x in self.lines if re.match(r"^(?:De|From) ?:", x)), ""))
        self.at = [i for i, x in enumerate(self.lines) if x.strip()]
        self.kind = [line_kind(self.lines[i].rstrip("\r"), names) for i in self.at]
        self.gap = [int(k > 0 and self.at[k] - self.at[k - 1] > 1) for k in range(len(self.at))]
        self.head = 0
        while self.head < len(self.at) and self.kind[self.head] == KIND["field"] and (self.head == 0 or not self.gap[self.head]):
            self.head += 1
        self._neighbours()

    def _neighbours(self) -> None:
        """Features that take several lines: where a run of header fields starts inside the mail, and introductions cut over lines."""
        n, k = len(self.at), self.kind
        for i in range(self.head, n):
            if k[i] == KIND["field"] and not (i + 1 < n and k[i + 1] == KIND["field"]) and not (i > self.head and k[i - 1] in (KIND["field"], KIND["forward"])):
                k[i] = KIND["text"]  # a lone line that merely looks like a header field
        for i in range(self.head + 1, n):
            # A comparison at the start of a wrapped line is no quotation.
            if k[i] == KIND["quote"] and not self.gap[i] and k[i - 1] in (KIND["text"], KIND["greeting"]) and re.match(r"> ?\d+ ?%", self.lines[self.at[i]]):
                k[i] = KIND["text"]
        tail = {KIND[x] for x in ("short", "contact", "device")}
        rules = (KIND["closing"], KIND["rule"], KIND["dashes"])
        for i in range(self.head, n - 1):
            # A short capitalised line that opens a block and stands right over a role or contact line is a name.
            if k[i] == KIND["short"] and k[i + 1] in tail and not self.gap[i + 1] and (self.gap[i] or k[i - 1] in rules):
                k[i] = KIND["name"]
        for i in range(self.head, n):
            if k[i] == KIND["wrote"]:
                for j in (i - 1, i - 2):
                    if j >= self.head and not self.gap[j + 1] and k[j] in (KIND["intro"], KIND["address"], KIND["short"]):
                        k[j] = KIND["intro"]
                    else:
                        break

    def observed(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """(kind, end, blank line before, allowed states as bits) of each line."""
        ends = [line_end(self.lines[i]) for i in self.at]
        return self.kind, ends, self.gap, [allowed(k, i < self.head) for i, k in enumerate(self.kind)]


def allowed(kind: int, in_head: bool) -> int:
    """The states a line can be in, as bits; only lines that are certain by themselves have fewer than all that follow the head."""
    if in_head:
        return 1 << HEAD
    if kind == KIND["quote"]:
        return 1 << QUOTATION | 1 << EARLIER_TEXT
    if kind == KIND["forward"]:
        return 1 << EARLIER
    if kind == KIND["dashes"]:
        return 1 << SIGN | 1 << EARLIER_TEXT
    return (1 << len(STATES)) - 1 - (1 << HEAD)


def seed_labels(mail: Mail) -> list[int]:
    """The label of each line that is certain by itself, else -1."""
    out = []
    for bits in mail.observed()[3]:
        labels = {y for s, y in enumerate(STATE_LABEL) if bits >> s & 1}
        out.append(labels.pop() if len(labels) == 1 else -1)
    return out


class Batch:
    """Observed lines of several mails, longest first, so that the mails that have a line t are the first live[t]."""

    def __init__(self, mails: list[tuple]):
        n = np.array([len(m[0]) for m in mails])
        self.order = np.argsort(-n, kind="stable")
        self.n = n[self.order]
        size = (len(mails), int(self.n[0]))
        self.kind, self.end, self.gap, bits = (np.zeros(size, np.int64) for _ in range(4))
        for row, i in enumerate(self.order):
            for a, v in zip((self.kind, self.end, self.gap, bits), mails[i]):
                a[row, : self.n[row]] = v
        self.may = (bits[:, :, None] >> np.arange(len(STATES)) & 1).astype(float)
        self.live = [int((self.n > t).sum()) for t in range(size[1])]


def batches_of(mails: list[tuple], size: int = 256) -> Iterator[tuple[list[int], Batch]]:
    """Mails with lines in batches of similar length, with their places in the list."""
    by = sorted((i for i, m in enumerate(mails) if len(m[0])), key=lambda i: -len(mails[i][0]))
    for i in range(0, len(by), size):
        part = by[i : i + size]
        yield part, Batch([mails[k] for k in part])


class LineModel:
    """A hidden Markov model over the lines of a mail: a state shows a kind and an end of line, and steps to the next line's state, with a blank line between or without."""

    def __init__(self, start: np.ndarray, step: np.ndarray, kind: np.ndarray, end: np.ndarray):
        self.start, self.step, self.kind, self.end = start, step, kind, end

    @classmethod
    def expected(cls) -> LineModel:
        """The model before anything is learned."""
        kind = np.zeros((len(STATES), len(KINDS)))
        kind[OPEN, :] = 0.01
        kind[[QUOTATION, SIGN], KIND["post"]] = 0.0  # a postscript is never part of a sign-off or a marked quotation
        for s, names in EXPECTED.items():
            kind[s, [KIND[k] for k in names]] = 1.0
        steps = np.array(FIRST_STEPS)
        return cls(np.eye(len(STATES))[HEAD], np.stack([steps / steps.sum(axis=1, keepdims=True)] * 2), kind / kind.sum(axis=1, keepdims=True), np.full((len(STATES), len(ENDS)), 1 / len(ENDS)))

    @classmethod
    def learned(cls, counts: list[np.ndarray]) -> LineModel:
        """The model of expected counts, held to the first expectation by its share ANCHOR, so that states keep their meaning."""
        first = cls.expected()
        shares = [c / np.maximum(c.sum(axis=-1, keepdims=True), 1e-9) for c in counts]
        got = [(1 - ANCHOR) * c + ANCHOR * p for c, p in zip(shares, (first.start, first.step, first.kind, first.end))]
        return cls(*(g / g.sum(axis=-1, keepdims=True) for g in got))

    def shown(self, b: Batch) -> np.ndarray:
        return self.kind.T[b.kind] * self.end.T[b.end] * b.may

    def count(self, b: Batch) -> list[np.ndarray]:
        """Expected counts of starts, steps, kinds and ends over a batch (forward and backward sums)."""
        shown = self.shown(b)
        ahead, scale = np.zeros_like(shown), np.ones(shown.shape[:2])
        for t, n in enumerate(b.live):
            v = self.start * shown[:n, 0] if t == 0 else np.einsum("bi,bij->bj", ahead[:n, t - 1], self.step[b.gap[:n, t]]) * shown[:n, t]
            scale[:n, t] = np.maximum(v.sum(axis=1), 1e-300)
            ahead[:n, t] = v / scale[:n, t, None]
        start, step = np.zeros_like(self.start), np.zeros_like(self.step)
        kind, end = np.zeros_like(self.kind), np.zeros_like(self.end)
        back = np.ones_like(shown)
        for t in range(len(b.live) - 1, -1, -1):
            n = b.live[t]
            here = ahead[:n, t] * back[:n, t]
            here /= np.maximum(here.sum(axis=1, keepdims=True), 1e-300)
            np.add.at(kind.T, b.kind[:n, t], here)
            np.add.at(end.T, b.end[:n, t], here)
            if t == 0:
                start += here.sum(axis=0)
                break
            right = shown[:n, t] * back[:n, t] / scale[:n, t, None]
            m = self.step[b.gap[:n, t]]
            both = ahead[:n, t - 1, :, None] * m * right[:, None, :]
            np.add.at(step, b.gap[:n, t], both)
            back[:n, t - 1] = np.einsum("bij,bj->bi", m, right)
        return [start, step, kind, end]

    def label(self, mails: list[tuple]) -> list[list[int]]:
        """The labels of the most probable states of each mail's lines (Viterbi)."""
        out: list[list[int]] = [[] for _ in mails]
        for places, b in batches_of(mails):
            with np.errstate(divide="ignore"):  # a step of 0 is never taken
                shown, step = np.log(self.shown(b)), np.log(self.step)
                best = np.log(self.start) + shown[:, 0]
            back = np.zeros(shown.shape, np.int64)
            last = best.argmax(axis=1)
            for t, n in list(enumerate(b.live))[1:]:
                way = best[:n, :, None] + step[b.gap[:n, t]]
                back[:n, t] = way.argmax(axis=1)
                best = way.max(axis=1) + shown[:n, t]
                last[:n] = best.argmax(axis=1)
            for row, i in enumerate(b.order):
                s, path = int(last[row]), []
                for t in range(b.n[row] - 1, -1, -1):
                    path.append(STATE_LABEL[s])
                    s = int(back[row, t, s])
                out[places[i]] = path[::-1]
        return out


def mails(df: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(doc_id, text) of the rows whose text begins with message header lines, whatever their type says."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(HEADER_START))


_PARTS = ("start", "step", "kind", "end")


def train_lines(mail: DataFrame, max_emails: int = MAX_EMAILS, rounds: int = ROUNDS) -> LineModel:
    """Learn the model by expectation and maximisation from lines of which only those certain by themselves are held fast.

    In each round the tasks add up the expected counts of their mails, Spark sums them, and a few hundred
    numbers come back. The sample is bounded: of more than max_emails mails, those whose id's hash is 0
    modulo a number that leaves about so many.
    """
    text_batches(mail.sparkSession)
    every = max(1, -(-mail.count() // max_emails))
    sample = mail.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([Mail(t).observed() for t in p["text"]], columns=["kind", "end", "gap", "may"])

    seen = materialize(sample.mapInPandas(observe, "kind array<int>, end array<int>, gap array<int>, may array<int>"), "lines")
    model = LineModel.expected()
    for _ in range(rounds):
        now = model

        def count(batches: Iterator[pd.DataFrame], now: LineModel = now) -> Iterator[pd.DataFrame]:
            for p in batches:
                rows = []
                for _, b in batches_of(list(zip(p["kind"], p["end"], p["gap"], p["may"]))):
                    for part, c in zip(_PARTS, now.count(b)):
                        rows += [(part, i, float(v)) for i, v in enumerate(c.ravel()) if v]
                yield pd.DataFrame(rows, columns=["part", "i", "n"])

        got = seen.mapInPandas(count, "part string, i int, n double").groupBy("part", "i").agg(F.sum("n").alias("n")).collect()
        counts = {part: np.zeros_like(c) for part, c in zip(_PARTS, (model.start, model.step, model.kind, model.end))}
        for r in got:
            counts[r["part"]].flat[r["i"]] = r["n"]
        model = LineModel.learned([counts[part] for part in _PARTS])
    discard(seen)
    return model


def label_lines(mail: DataFrame, model: LineModel) -> DataFrame:
    """(doc_id, line_no, label, text) of every non-blank line of the mails (doc_id, text); lines are cut at LF and counted from 1."""
    shipped = mail.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    text_batches(mail.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            mails = [Mail(t) for t in p["text"]]
            rows = []
            for d, m, labels in zip(p["doc_id"], mails, shipped.value.label([m.observed() for m in mails])):
                rows += [(d, i + 1, LABELS[y], m.lines[i]) for i, y in zip(m.at, labels)]
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "label", "text"])

    return mail.mapInPandas(run, "doc_id string, line_no int, label string, text string")


def new_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """(doc_id, line_no, text) of the lines newly written by each e-mail's sender.

    Texts that are null, empty or begin with no header line are no e-mails and give no rows. An e-mail
    without new text gives none either. A row that repeats an id is labelled by itself.
    """
    m = mails(df, id_col, text_col)
    return label_lines(m, train_lines(m)).filter("label = 'new'").select("doc_id", "line_no", "text")
