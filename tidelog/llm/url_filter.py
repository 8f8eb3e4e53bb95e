"""URL filter by a weighted vocabulary, with host and path rules before it.

One Aho-Corasick pass over host and path counts terms that stand between boundaries (no ASCII letter or digit next to
them). One strict term rejects; so do several distinct soft terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms of the vocabulary, by subject; one strict term rejects, soft ones count once each.
STRICT = tuple("""
    porn porno pornos xxx hentai milf camgirls camsex escorts bdsm blowjob cumshot gangbang creampie deepthroat upskirt nudes sexcam sexcams sexshop redtube youporn xhamster xvideos
    hardcore-sex free-porn live-sex adult-video adult-cams putas pornos-gratis sexkontakte nacktbilder erotik-chat
    casino casinos sportsbook online-casino slot-machines blackjack roulette baccarat onlinecasino spielcasino apuestas-deportivas
    warez keygen keygens torrents cracked serialz nulled crackz full-crack
    viagra cialis levitra kamagra tramadol xanax payday-loans cheap-pills buy-viagra online-pharmacy no-prescription
    malware phishing ransomware spyware botnet carding cvv-shop fake-passport replica-watches
""".split())
SOFT = tuple("""
    adult sex sexy nude naked erotic erotik erotica fetish lingerie webcam webcams hot-girls dating singles hookup flirt
    bet bets betting poker slots jackpot lottery lotto bingo wager apuestas wetten paris-sportifs
    pills pharmacy steroids weight-loss diet-pills
    loan loans credit-repair crypto forex binary-options get-rich earn-money make-money work-from-home
    cheap free win winner prize bonus giveaway
    download downloads crack cracks serial hack hacks hacked cheats torrent proxy unblocked stream-free watch-online
    replica fake counterfeit cigarettes vape tobacco ammo
    gratis kostenlos gratuit
""".split())
#: The rules of the registered query, as (action, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SOFT_DISTINCT = 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The fitting rule with the longest host and path together (then the longest host, then by name), as struct(rule, action), or null."""
    out = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r)):
        fits = ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,action:string>")


class Vocabulary:
    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        self.automaton = ahocorasick.Automaton()
        for weight, terms in ((1, soft), (2, strict)):  # a term in both counts as strict
            for t in terms:
                self.automaton.add_word(t, (t, weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def count(self, text: str) -> tuple[list[str], list[str]]:
        """Distinct strict and soft terms between boundaries, sorted."""
        found: tuple[set[str], set[str]] = (set(), set())
        if text and len(self.automaton):
            n = len(text)
            for end, (term, weight) in self.automaton.iter(text):
                start = end - len(term)
                if (start < 0 or not (text[start].isascii() and text[start].isalnum())) and (end + 1 == n or not (text[end + 1].isascii() and text[end + 1].isalnum())):
                    found[2 - weight].add(term)
        return sorted(found[0]), sorted(found[1])


def url_verdicts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_distinct: int = SOFT_DISTINCT) -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule``, ``verdict``, ``strict_terms``, ``soft_terms``. A url of any length is read whole, in one pass.

    Terms are sought in lower-cased host and path. A fitting rule decides, the longest first; else one strict or
    ``soft_distinct`` distinct soft terms block. Null, empty and malformed urls have empty host and path, no terms, and are
    allowed. Repeated rows are judged each; extra columns are left out. A narrow map over the url column alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(strict, soft)
        for b in batches:
            found = [vocabulary.count(h + p.lower()) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            terms = [pa.array([f[k] for f in found], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *terms], [*b.schema.names, "strict_terms", "soft_terms"])

    url = F.col("url")
    judged = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.mapInArrow(run, "id bigint, host string, path string, strict_terms array<string>, soft_terms array<string>")
    best = best_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.size("strict_terms") > 0) | (F.size("soft_terms") >= soft_distinct), "block").otherwise("allow")
    return judged.withColumn("best", best).select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", own).alias("verdict"), "strict_terms", "soft_terms")
