import pytest

from tapline.llm import spam

STUFFED = [
    "cheap iot cable buy iot cable best iot cable online iot cable top sim card free sim card buy sim card iot cable",
    "#simcard #simcard12 #simcardbuy #vpnbox #vpnbox7 #vpnboxcheap #simcard99 #vpnbox #simcard #simcardtop",
    "\n".join(f'<a href="http://x{i}.test/buy/{i}">sim antenna</a>' for i in range(12)),
    "Our sim card is the best sim card for your sim card. With sim card you get sim card, router and sim card. " * 4,
    "\n".join(f"Vendor{i} X{i} iot hosting new" for i in range(20)),
]
PLAIN = [
    "The collector wrote its output twice after the upgrade, once per worker, and nobody on shift could explain why.",
    "```\n" + "tool --read-dir /data/a --net-id b --format json\n" * 8 + "```\nRun the job again.",
    "\n".join(f"2025-01-0{i}T10:00:00.000Z WARN query id={i} name=a{i}.example no answer" for i in range(1, 9)) + "\nThe alert cleared by itself.",
    "issuer | destination | name | source | port\n" + "\n".join(f"10.0.0.{i} | 242.0.0.{i} | a{i}.example | dns+synack | 443" for i in range(9)) + "\nSee the table.",
    "We tested this router for a month and it kept the session open; the antenna is good, but the manual could say more about the port.",
    None, "", "   ", "!!!",
]


@pytest.mark.parametrize("text", STUFFED)
def test_stuffed(text):
    assert spam.spam_share(text)[0] > 0.5


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert spam.spam_share(text)[0] <= 0.5


def test_greater_part_decides(spark):
    rows = [(1, STUFFED[0], 1.0), (2, STUFFED[0] + "\n" + PLAIN[0] * 4, 1.0), (3, None, 1.0), (4, STUFFED[0] * 3000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, share double")
    assert sorted(r[0] for r in spam.spam_pages(df).collect()) == [1, 4]
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_labelled_sample(spark):
    """Against labels on which all raters agree."""
    folder = "/root/testdata/sf0.1"
    docs, votes = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "spam_labels"))
    sure = votes.groupBy("doc_id").agg({"is_spam": "avg", "rater": "count"}).toDF("doc_id", "vote", "n").filter("n > 1 and vote in (0, 1)")
    got = sure.join(spam.scored(docs), "doc_id").selectExpr("(share > 0.5) = (vote > 0.5) as right").groupBy("right").count()
    counts = {r.right: r["count"] for r in got.collect()}
    assert counts[True] / sum(counts.values()) > 0.97


TAGS = [a + b for a in "ver lo mar tel sor pan rig bel".split() for b in "tano dex mira kulo fas zent".split()]


@pytest.mark.parametrize("text", [" ".join("#" + t for t in TAGS), "\n".join(TAGS), "\n".join(f'<a href="http://{a}.test/{b}">{b} {a}</a>' for a, b in zip(TAGS[::2], TAGS[1::2]))])
def test_distinct_lists(text):
    assert spam.spam_share(text)[0] > 0.5
    assert spam.spam_share(PLAIN[0] + "\n" + PLAIN[4] + "\n" + " ".join(TAGS[:24]))[0] <= 0.5


def test_short_headings_are_no_list():
    assert spam.spam_share("Router setup\nAntenna mounting\nPower supply notes")[0] == 0


@pytest.mark.parametrize("text", ["```\n" + STUFFED[0], "\n".join(["sim card | destination sim | buy sim card | sim"] * 9), "\n".join(f"sim card -sale http://x{i}.test/sim" for i in range(9))])
def test_loose_marks_do_not_excuse(text):
    assert spam.spam_share(text)[0] > 0.5


@pytest.mark.parametrize("before", ["```\n", "2024-05-01 10:00:00 ", "2024-05-01T10:00 WARN ", "| | | destination ", "--sale /buy "])
@pytest.mark.parametrize("text", [STUFFED[0], STUFFED[3]])
def test_marks_before_a_page_do_not_excuse(before, text):
    assert spam.spam_share(before + text)[0] > 0.5


@pytest.mark.parametrize("folder", ["sf0.1", "check_s"])
def test_held_out_labels(folder):
    """The mass was set between the two kinds of the half of sf0.1's labels with an even checksum; this is the rest."""
    import zlib

    import pyarrow.parquet as pq

    place = f"/root/testdata/{folder}"
    texts = dict(zip(*(pq.read_table(f"{place}/documents.parquet", columns=["doc_id", "text"])[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    votes = pq.read_table(f"{place}/spam_labels.parquet").to_pandas().groupby("doc_id").is_spam.agg(["sum", "count"])
    sure = votes[(votes["count"] > 1) & ((votes["sum"] == 0) | (votes["sum"] == votes["count"]))]
    found = right = spam_pages = 0
    for doc, row in sure.iterrows():
        if folder == "sf0.1" and zlib.crc32(str(doc).encode()) % 2 == 0:
            continue
        said, true = spam.spam_share(texts[doc])[0] > 0.5, row["sum"] > 0
        found, right, spam_pages = found + said, right + (said and true), spam_pages + true
    assert right >= 0.95 * spam_pages > 0 and right >= 0.95 * found


def test_autocorrelation_counts_all_pairs_at_a_lag():
    import random

    import numpy as np

    rng = random.Random(1)
    code = [rng.choice([-1, 0, 0, 1, 2, 3]) for _ in range(300)]
    want = [sum(code[i] >= 0 and code[i] == code[i - lag] for i in range(lag, 300)) for lag in range(1, 41)]
    assert spam.autocorrelation(np.array(code)).tolist() == want
    assert spam.autocorrelation(np.array([], dtype=np.int64)).sum() == 0
