"""Column names and types of the input tables.

Ids are ``bigint`` and years ``int`` throughout.
"""

PAPERS = """paperid bigint, doi string, doctype string, papertitle string, originaltitle string, booktitle string,
    year int, date date, publisher string, journalid bigint, conferenceinstanceid bigint, referencecount bigint,
    citationcount bigint, originalvenue string, familyid bigint"""

PAPER_FIELDS = "paperid bigint, fieldofstudyid bigint, score double"
FIELDS = "fieldofstudyid bigint, displayname string, normalizedname string, level int"
ONTOLOGY = "SDG_label string, fos_id bigint"

AUTHORS = """paperid bigint, authorid bigint, affiliationid bigint, authorsequencenumber int,
    originalauthor string, originalaffiliation string"""

# Names of a file without header, with placeholders for unused columns.
CORPUS = ", ".join(
    ["paperid bigint", "rank int", "doi string", "type string", "title_normalised string", "title string",
     "unknown1 string", "year int", "date string", "unknown2 string", "publisher string"]
    + [f"unknown{i} string" for i in range(3, 13)]
    + ["journal string"]
    + [f"unknown{i} string" for i in range(14, 17)]
)

OPEN_ACCESS = """doi string, is_oa boolean, oa_status string, has_repository_copy boolean,
    oa_locations array<struct<is_best: boolean, host_type: string>>"""

FUNDERS = "doi string, funder string"
JOURNALS = "journalid bigint, year int, mean_citations double"
CONFERENCES = "conferenceinstanceid bigint, citationcount bigint, papercount bigint"
LABELS = "paperid bigint, SDG_label string"

AFFILIATIONS = """affiliationid bigint, rank int, normalizedname string, displayname string, gridid string,
    officialpage string, wikipage string, papercount bigint, citationcount bigint, latitude double,
    longitude double, createddate string, country string"""

AFFILIATION_COUNTRIES = "affiliationid bigint, country_code string, Alpha3 string"
COUNTRIES = "country_code string, country_name string, continent string, sub_continent string"
INCOME_COUNTRIES = """country_code string, region string, short_name string, income_group string,
    currency_unit string"""

# Names in the headers of the country and income files.
COUNTRY_HEADER = {
    "ISO-alpha3 Code": "country_code",
    "Country or Area": "country_name",
    "Region Name": "continent",
    "Sub-region Name": "sub_continent",
}
INCOME_HEADER = {
    "Country Code": "country_code",
    "Region": "region",
    "Short Name": "short_name",
    "Income Group": "income_group",
    "Currency Unit": "currency_unit",
}

INDICATORS = """country_name string, country_code string, indicator_code string, indicator_name string,
    year int, value double"""
RANKING = """University string, Country string, Period string, Field string, Frac_counting int,
    P_top10 string, PP_top10 string, impact_P string"""
RANKING_KEY = "affiliationid string, University string"
AUTHOR_METADATA = "authorid bigint, gender string"
COUNTRY_CODES = "Alpha2 string, Alpha3 string"
OPEN_COUNTS = "year int, records array<struct<key_display_name: string, count: bigint>>"

# Fields of an institution record.  Lists of records stay nested.
INSTITUTION = """id string, display_name string, display_name_alternatives array<string>,
    display_name_acronyms array<string>, display_name_international string, ror string, ids map<string, string>,
    country_code string, geo struct<city: string, region: string, country_code: string, country: string,
    latitude: double, longitude: double>, type string, homepage_url string, image_url string,
    image_thumbnail_url string, associated_institutions array<struct<id: string, ror: string,
    display_name: string, country_code: string, type: string, relationship: string>>, relevance_score double,
    works_count bigint, cited_by_count bigint, counts_by_year array<struct<year: int, works_count: bigint,
    cited_by_count: bigint>>, works_api_url string, x_concepts array<struct<id: string, wikidata: string,
    display_name: string, level: int, score: double>>, updated_date string, created_date string"""
