import pytest

from siltloom.operators.discover import links_of
from siltloom.plans.catalogue import ALLOW, DENY, bfs_pages, bfs_pages_limit, index_replace_docs, site_run_pages

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    out = {}
    for r in sorted(spark.read.parquet(f"{D}/pages_in.parquet").select("url", "html", "page_id", "fetched_at").collect(), key=lambda r: (r["fetched_at"], r["page_id"])):
        out[r["url"]] = (r["html"], min(out.get(r["url"], (None, r["page_id"]))[1], r["page_id"]))
    return {u: (first, links_of(h, u, "", "a[href]")) for u, (h, first) in out.items()}


@pytest.mark.parametrize("query", [bfs_pages, bfs_pages_limit])
def test_links_of_whole_table(spark, pages, query):
    """A queue, as the definition has it."""
    limit, allow, deny = (17, ALLOW, DENY) if query is bfs_pages_limit else (1 << 40, ("",), ("-",))
    expected = []
    for url, (start, _) in pages.items():
        queue, seen, found = [(url, ())], set(), []
        for at, path in queue:
            if len(found) >= limit:
                break
            if at in seen or len(path) > 2:
                continue
            seen.add(at)
            for i, link in enumerate(pages.get(at, (0, []))[1]):
                if not link.startswith(allow) or link.startswith(deny):
                    continue
                found.append((*path, len([x for x in pages[at][1][:i] if x.startswith(allow) and not x.startswith(deny)])))
                expected.append((start, ".".join(map(str, found[-1])), link))
                queue.append((link, found[-1]))
                if len(found) >= limit:
                    break
    got = [tuple(r) for r in query(spark, D).select("start", "place", "url").collect()]
    assert sorted(got) == sorted(expected) and len(got) > len(pages)


def test_run_and_snapshot_over_whole_tables(spark, pages):
    found = {r["url"] for r in bfs_pages(spark, D).select("url").distinct().collect()}
    ids = [r["id"] for r in site_run_pages(spark, D).collect()]
    assert ids and len(ids) == len(set(ids)) and set(ids) <= found & set(pages)
    docs = spark.read.parquet(f"{D}/index_docs.parquet").select("id", "title", "sp_intro", "crawl_process_id", "indexed_at", "entry_id").collect()
    bad = {r[0] for r in spark.read.parquet(f"{D}/run_status.parquet").where("errors > 0").select("crawl_process_id").collect()}
    failed = {r["id"] for r in docs if r["crawl_process_id"] in bad and (r["title"] is None or r["sp_intro"] is None)}
    expected = {}
    for late in (False, True):
        new = {}
        for r in docs:
            if (r["crawl_process_id"] in bad) is late and not (late and r["id"] in failed):
                new.setdefault(r["id"], []).append((r["indexed_at"], r["entry_id"], r["title"], r["sp_intro"]))
        expected |= {k: max(v, key=lambda x: x[:2])[2:] for k, v in new.items()}
    assert {r["id"]: (r["title"], r["sp_intro"]) for r in index_replace_docs(spark, D).collect()} == expected
