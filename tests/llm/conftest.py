import pytest


@pytest.fixture(scope="session")
def sites(spark):
    rows = [("s_a", "Alpha", "https://a.example/", "de", "Europe/Berlin", "dmy", 60, 120), ("s_b", "Beta_Ville", "https://b.example/", "en", "UTC", "dmy", None, None)]
    return spark.createDataFrame(rows, "sp_source string, site_key string, base_url string, lang string, time_zone string, date_order string, title_max_chars int, intro_max_chars int")
