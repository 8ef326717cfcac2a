"""Licence scans by canonical digest lookup."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import by_row, stored, travels
from grainmill.llm.license_digests import DIGESTS
from grainmill.llm.license_texts import KNOWN, NAMES, SPDX, STARTS, TAILS

travels(__name__)

#: Paragraphs in a run that is looked up as one block.
RUN = 8

# Spellings that licence matching treats alike, in the canonical form on the right.
EQUIVALENT = {
    b"licence": b"license", b"licences": b"licenses", b"licenced": b"licensed", b"licencing": b"licensing", b"sublicence": b"sublicense",
    b"acknowledgement": b"acknowledgment", b"acknowledgements": b"acknowledgments", b"analog": b"analogue", b"analyze": b"analyse",
    b"artifact": b"artefact", b"authorization": b"authorisation", b"authorized": b"authorised", b"caliber": b"calibre", b"canceled": b"cancelled",
    b"capitalizations": b"capitalisations", b"catalog": b"catalogue", b"categorize": b"categorise", b"center": b"centre", b"color": b"colour",
    b"emphasized": b"emphasised", b"favor": b"favour", b"favorite": b"favourite", b"fulfill": b"fulfil", b"fulfillment": b"fulfilment",
    b"initialize": b"initialise", b"judgment": b"judgement", b"labeling": b"labelling", b"labor": b"labour", 
    b"modeling": b"modelling", b"modernize": b"modernise", b"noncommercial": b"non commercial", b"organization": b"organisation",
    b"organize": b"organise", b"practice": b"practise", b"program": b"programme", b"realize": b"realise", b"recognize": b"recognise",
    b"signaling": b"signalling", b"utilization": b"utilisation", b"while": b"whilst", b"wilfull": b"wilful", b"noninfringement": b"non infringement",
    b"https": b"http", b"owner": b"holder", b"owners": b"holders",
}
#: A line that is only a copyright statement, "all rights reserved", or a heading that names the licence.
STATEMENT = re.compile(rb"^[\s\W]*(?:copyright\b|\(c\)|\xc2\xa9|all rights reserved\b)[^\n]*$", re.I | re.M)
LIST_MARK = re.compile(rb"^\s*(?:[-*\xe2\x80\xa2]+|\(?[0-9a-z]{1,2}[.)])\s+", re.I | re.M)
#: A-Z lowered; digits, letters and bytes beyond ASCII stay; all else is a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Dashes and quotation marks beyond ASCII are punctuation too.
MARKS = re.compile(rb"\xe2\x80[\x90-\x9f\xa2\xa6]|\xc2[\xab\xbb\xa9\xb7]")


def canonical(text: str | None) -> bytes:
    """The words of the text without case, punctuation, list marks and copyright lines, in canonical spelling."""
    raw = (text or "").encode()
    low = raw.lower()
    if b"copyright" in low or b"(c)" in low or b"\xc2\xa9" in raw or b"all rights reserved" in low:
        raw = STATEMENT.sub(b"", raw)
    raw = LIST_MARK.sub(b"", raw)
    if b"\xe2\x80" in raw or b"\xc2" in raw:
        raw = MARKS.sub(b" ", raw)
    words = raw.translate(NORMAL).split()
    return b" ".join([EQUIVALENT.get(w, w) for w in words])


def digest(text: str | None) -> tuple[int, str]:
    """Words of the canonical text, and its SHA-256."""
    words = canonical(text)
    return words.count(b" ") + 1 if words else 0, hashlib.sha256(words).hexdigest()


def blocks(text: str | None) -> list[bytes]:
    """Half digests of the text's lines, paragraphs, and runs of two to RUN paragraphs, each once.

    Paragraphs end at lines without canonical words, such as blank lines, bare comment marks and copyright lines.
    """
    lines = [canonical(line) for line in (text or "").split("\n")]
    paragraphs: list[list[bytes]] = [[]]
    for line in lines:
        if line:
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    whole = [b" ".join(p) for p in paragraphs if p]
    found = [hashlib.sha256(line).digest()[:16] for line in lines if line]
    for k in range(len(whole)):
        run = hashlib.sha256(whole[k])
        found.append(run.digest()[:16])
        for more in whole[k + 1 : k + RUN]:
            run.update(b" " + more)
            found.append(run.digest()[:16])
    return list(dict.fromkeys(found))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """digest, license_id of the given (license_id, text) rows, or of the built-in texts; the smallest id where two agree."""
    texts = known
    if known is None:
        names = spark.createDataFrame([(i, name) for i, own in NAMES.items() for name in own], "license_id string, name string")
        begun = names.select("license_id", "name", F.explode(F.array(*map(F.lit, STARTS))).alias("start"))
        ended = begun.select("license_id", F.concat("start", "name").alias("text"), F.explode(F.array(*map(F.lit, TAILS))).alias("tail"))
        notices = ended.select("license_id", F.concat("text", "tail").alias("text"))
        texts = spark.createDataFrame([*KNOWN, *SPDX], "license_id string, text string").unionAll(notices)
    made = by_row(texts, ["text"], ["license_id"], "n_words bigint, digest string", lambda: digest).where("n_words > 0 and license_id is not null").select("digest", "license_id")
    if known is None:
        made = made.unionAll(spark.createDataFrame([(d, i) for i, d in DIGESTS], "digest string, license_id string"))
    return made.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Look up the canonical digest of each whole text, and of each of its lines, paragraphs and runs of paragraphs, among known licences.

    Returns doc_id, n_words (of the canonical text), digest, license_id (null: no known licence), notice_ids (licences
    whose known text is a line, a paragraph or up to RUN paragraphs of a text with this doc_id, sorted), one row per input row. Null, empty and wordless texts
    have no words, the digest of nothing and no licence. Repeated rows repeat; other columns are ignored.
    """
    table = stored(known_digests(docs.sparkSession, known), "licenses")
    if known is None:  # some ten thousand rows, whatever the documents
        table = F.broadcast(table)

    def start():
        def one(text: str | None) -> tuple:
            # Half of a block's digest finds it; the digests of whole texts are joined whole.
            return *digest(text), blocks(text)

        return one

    scanned = stored(by_row(docs, ["text"], ["doc_id"], "n_words bigint, digest string, lines array<binary>", start), "digests")
    half = table.select(F.unhex(F.substring("digest", 1, 32)).alias("line"), "license_id")
    lines = scanned.select("doc_id", F.explode("lines").alias("line")).join(half, "line")
    notices = lines.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_set("license_id")).alias("notice_ids"))
    whole = scanned.join(table, "digest", "left").join(notices, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return whole.select("doc_id", "n_words", "digest", "license_id", F.coalesce("notice_ids", F.array().cast("array<string>")).alias("notice_ids"))
