"""Record shapes of the pipeline. Optional fields are null where they are absent."""

from __future__ import annotations

START_URLS = "ord int, url string, extraction_depth int"
PAGES = "url string, html string"
RESPONSES = "url string, status int, retry_after string, body string, error string"
LINKS = "src_url string, pos int, dst_url string"
URLS = "ord bigint, url string"
TEASERS = "url string, title string, introText string, datetime timestamp"
DOCUMENTS = "id string, title string, sp_intro string, sp_date timestamp, url string, sp_objecttype string, crawl_process_id string, sp_source array<string>"
RUN_STATUS = "total int, processed int, errors int"
