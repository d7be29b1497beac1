"""The listed names are blocked under every ending, not only where one table has them."""

import pytest

from vigil.llm import urlfilter


@pytest.mark.parametrize("limit", [1 << 24, 10])
def test_names_under_every_ending(spark, limit):
    hosts = [f"{n}.example.{e}" for n in urlfilter.BLOCKED_NAMES for e in ("com", "net", "org")]
    hosts = [h for h in hosts if h != "free-bets.example.org"]  # test_urls holds it as allowed
    assert len(hosts) == 17
    rows = [(k, f"https://{sub}{h}") for k, (sub, h) in enumerate((s, h) for h in hosts for s in ("", "m."))] + [(900, "https://good.example.org"), (901, "https://xcasino-win.example.org")]
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), max_bits=limit).collect()}
    assert got == {k: "allow" if k >= 900 else "block" for k, _ in rows}
