"""A small labelled table of URLs: unwanted ones (gambling, pills, adult, trackers, link farms, fraud) and plain ones.

The words below were labelled by hand, without a look at any rule list, and the URLs are made from them by one rule,
the same for both labels, so that language, domain ending and page number tell nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

#: What the sites are about, and words that stand beside it.
UNWANTED = """
casino poker slots jackpot roulette bets betting sportsbook pills viagra pharmacy drugs adult porn xxx nude escort dating ads adserver
tracking clicks popups spam linkfarm backlinks mailer loans payday prize giveaway replica phishing warez keygen
""".split()
PLAIN = """
library museum news weather garden recipes history archive college school science journal physics biology music theatre cinema books
poetry travel mountains railway airport council justice health hospital sports chess cooking bakery farmers paper software database maps
astronomy photos painting language dictionary students teachers parents market forest harbour bridge river village
""".split()
BESIDE_UNWANTED = "best cheap free online win hot mega quick".split()
BESIDE_PLAIN = "city north open old green state public local".split()

_ENDS = ("com", "org", "net", "info")
_LANGUAGES = ("en", "de", "fr", "es")


def labelled_urls() -> Iterator[tuple[str, int]]:
    """Rows (url, blocked): each word as a host alone and beside four others, and in the path of a host that says nothing."""
    for blocked, words, beside in ((0, PLAIN, BESIDE_PLAIN), (1, UNWANTED, BESIDE_UNWANTED)):
        for i, word in enumerate(words):
            others = [beside[(i + 2 * k) % len(beside)] for k in range(4)]
            hosts = [word, f"{others[0]}-{word}", f"{others[1]}{word}", f"{word}-{others[2]}", f"{word}{others[3]}"]
            for k, host in enumerate(hosts):
                yield f"https://{host}.{_ENDS[(i + k) % 4]}/{_LANGUAGES[(i // 4 + k) % 4]}/{7 * i + 31 * k}", blocked
            yield f"http://site{i % 8}.{_ENDS[i % 4]}/{_LANGUAGES[i // 4 % 4]}/{word}/{i}", blocked
