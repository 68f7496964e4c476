"""URL filter: host and path rules first, else logistic regression on character n-grams.

A rule (host, path, verdict) fits a URL if the URL's host is the rule's or a
subdomain of it and the URL's path starts with the rule's; the longest rule
(host and path together) decides, an equally long one by the smaller text. A
URL that no rule fits is judged by a logistic regression on hashed character
n-grams of host and path, trained from a small labelled URL table. The sums of
host and path are divided each by the root of its own number of telling n-grams, so that
no long path outweighs the host. The table is made by rule from lists of words, with many allowed names
of no known word, from which the bias is learnt.

Edge cases: a null URL or one without ``://`` has an empty host and path, which
no rule with a host fits; its score is 0 and its verdict allow; long URLs
are read whole; repeated rows are judged each; other columns pass through.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelens.llm.common import ascii_lower, scratch_name, tidy

SLOTS = 1 << 18
GRAMS = (3, 4, 5)
#: Words that tell a blocked host or path.
BLOCKED_WORDS = (
    "adult adserver banner bets betting bingo blackjack camgirl camsex cams casino clickbait cracked doorway erotic escort "
    "fakeid fetish gamble gambling hentai hookup hotgirls jackpot keygen lottery malware milf naked nude onlinebet "
    "payday pharma phish phishing pills pirate poker popads popup porn porno pornhub ransom replica roulette scam seolinks "
    "sexcam sexchat sexy slots spam spamlink spyware sportsbet steroids stripper tracker tracking trojan viagra warez "
    "weightloss xxx xxxtube cialis adtrack adclick"
).split()
#: Words of allowed hosts and paths; many share letters with the blocked ones.
ALLOWED_WORDS = (
    "academy adulteducation alphabet archive art astronomy bakery beads betterlife betty biology blog books botany "
    "bridge cameras campus castle caterpillar chemistry children cinema city climate college community cooking council cracker "
    "cycling daily dictionary docs downloads economy education encyclopedia energy essex farming festival forest forum "
    "garden geography health heads history hospital island journal kitchen language law leads library lotus market mathematics "
    "medicine middlesex museum music nature network news novels observatory orchestra parliament photo physics pillar pillow "
    "poetry popular postman racetrack radio railway recipes research river roads school science slotcar society soundtrack "
    "spaniel sports statistics story sussex theatre therapy thesis tourism trade travel university village weather wiki winter"
).split()
#: Words that both verdicts have.
FILLERS = "online best top the world shop club live 24 real big super now hub zone my old new".split()
#: Beginnings and ends of the syllables of made-up allowed names.
ONSETS = "b bl br c ch cl d dr f fl g gr h j k l m n p pl pr qu r s sh sl sp st str t th tr v w wh z".split()
VOWELS = "a e i o u ai ea ee ie io oo ou".split()
CODAS = " n r s l t d ck nd ng nt rd st th m".split(" ")
#: Made-up names in the labelled table: what a host looks like that nothing is known of.
MADE_UP = 900
#: A slot has a weight if its shares in both verdicts differ by a factor of e^TELLING.
TELLING = 0.7


def made_up_names(n: int, seed: int = 11) -> list[str]:
    """Names of two to four syllables, the same for each run."""
    rng = random.Random(seed)
    return ["".join(rng.choice(ONSETS) + rng.choice(VOWELS) + rng.choice(CODAS) for _ in range(rng.randint(2, 4)))
            for _ in range(n)]


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table, 1 for block, by rule: telling words alone and with fillers, in hosts and in paths.

    Made-up names and slugs are allowed, and stand around telling words too, so that only telling parts tell.
    """
    rng = random.Random(7)
    made = made_up_names(MADE_UP)
    hosts = [f"{a}{{}}.{b}{c}" for a in ("", "www.", "m.", "blog.") for b in ("", *(f"{m}." for m in made[:2]), "pages.", "sites.")
             for c in ("com", "org", "net", "info")]

    def slug() -> str:
        return rng.choice(("/", "/{}/{}", "/{}.html", "/{}/", "/{}-{}-{}", "/{}/{}.html", "/{}-{}-{}-{}-{}-{}-{}")).format(
            *(rng.choice((*made, *FILLERS, str(rng.randint(1, 2000)))) for _ in range(7)))

    out = []
    for y, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for word in words:
            fill = rng.sample(FILLERS, 5)
            forms = (word, f"{fill[0]}-{word}", f"{fill[1]}{word}", f"{word}-{fill[2]}", f"{word}{fill[3]}", f"{fill[4]}-{word}-{rng.choice(made)}")
            out += [(f"https://{h.format(form)}{slug()}", y) for h, form in zip(rng.sample(hosts, 6), forms)]
            out += [(f"https://{rng.choice(hosts).format(rng.choice(made))}{p}", y)
                    for p in (f"/{word}", f"/{word}/{fill[0]}", f"/{fill[1]}-{word}.html", f"/{rng.choice(made)}/{word}-{fill[2]}")]
    return out + [(f"https://{rng.choice(hosts).format(name)}{slug()}", 0) for name in made]


def grams(mark: str, text: str) -> list[int]:
    """Distinct hashed n-grams of a part of the URL."""
    text = f"^{text}$"
    out = {mark + text[i:i + n] for n in GRAMS for i in range(len(text) - n + 1)}
    return sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % SLOTS for g in out})


def slots(host: str, path: str) -> tuple[list[int], list[int]]:
    return grams("h", host), grams("p", path)


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = rest[:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    path = rest[end:]
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return (host, path[:stop]) if mark else ("", "")


def train(labelled: Iterable[tuple[str, int]], epochs: int = 600, rate: float = 0.5,
          decay: float = 1e-4) -> tuple[float, np.ndarray]:
    """Bias and weights, by gradient descent on the labelled table (bounded: it is an argument).

    Slots that both verdicts have alike, or the table never has, weigh 0 and don't count in the root. Without labelled URLs the bias allows all.
    """
    table = [(slots(*split_url(u)), y) for u, y in labelled]
    if not table:
        return -1.0, np.zeros(SLOTS)
    parts = [s for both, _ in table for s in both]
    part = np.repeat(np.arange(len(parts)), [len(s) for s in parts])
    col, at = np.unique(np.concatenate([np.array(s, np.int64) for s in parts]), return_inverse=True)
    y = np.array([y for _, y in table], float)
    share = [(np.bincount(at, (y == v)[part // 2], len(col)) + 0.5) / ((y == v).sum() + 1) for v in (0, 1)]
    telling = (np.abs(np.log(share[1] / share[0])) >= TELLING)[at]
    part, at = part[telling], at[telling]
    row, scale = part // 2, 1 / np.sqrt(np.bincount(part, minlength=len(parts)))[part]
    weight, bias = np.zeros(len(col)), 0.0
    for _ in range(epochs):
        z = bias + np.bincount(row, weight[at] * scale, len(y))
        error = 1 / (1 + np.exp(-z)) - y
        weight -= rate * (np.bincount(at, error[row] * scale, len(col)) / np.sqrt(len(y)) + decay * weight)
        bias -= rate * error.mean()
    out = np.zeros(SLOTS)
    out[col] = weight
    return float(bias), out


def score_of(host: str, path: str, bias: float, weight: np.ndarray) -> float:
    """Score of the regression; 0 without host and path."""
    if not host and not path:
        return 0.0
    z = bias
    for part in slots(host, path):
        own = weight[part]
        z += own.sum() / max(1, np.count_nonzero(own)) ** 0.5
    return float(1 / (1 + np.exp(-z)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, url: str = "url",
          labelled: Iterable[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """Append host, path, rule, score (of the regression, 0 to 1) and verdict to every row.

    ``rules`` and ``labelled`` are arguments on the driver and go to the tasks
    with the function; columns of these names in ``pages`` give way.
    """
    bias, weight = train(labelled_urls() if labelled is None else labelled)
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, host + path, verdict))
    added = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in pages.columns if c.lower() not in added]

    def fits(host: str, path: str) -> tuple[str, str] | None:
        found, name = [], host
        while name:
            found += [(-len(rule), rule, verdict) for start, rule, verdict in by_host.get(name, ())
                      if path.startswith(start)]
            name = name.partition(".")[2]
        return min(found)[1:] if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in added]
            for host, path in zip(batch.column(h).to_pylist(), batch.column(p).to_pylist()):
                score = score_of(host, path, bias, weight)
                rule = fits(host, path)
                verdict = rule[1] if rule else "block" if (host or path) and score >= threshold else "allow"
                for column, value in zip(out, (host, path, rule and rule[0], score, verdict)):
                    column.append(value)
            types = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(x, t) for x, t in zip(out, types))],
                names=[*kept, *added])

    schema = pages.select(*kept).schema
    for name in added:
        schema = schema.add(name, "double" if name == "score" else "string")
    h, p = scratch_name(pages, "host"), scratch_name(pages, "path")
    address = F.coalesce(F.regexp_extract(F.col(url), r"(?s)://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.col(url), r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))
    rows = pages.select(*kept, ascii_lower(address).alias(h), path.alias(p))
    return rows.mapInArrow(tidy(run), schema)
