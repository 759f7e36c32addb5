import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from profilescope.session import build_session  # noqa: E402
from profilescope.sources.documents import ingest_profiles  # noqa: E402

AS_OF = "2017-03-01T00:00:00Z"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def year(y):
    return f"{y}-05-06T07:08:09+00:00"


def document(i, start, added, weight, **more):
    base = {
        "id": i,
        "accepted": True,
        "desired_work_roles": [],
        "desired_work_roles_experience": [],
        "professional_experience": "2..4",
        "work_locations": ["Graz"],
        "current_location": "Graz",
        "work_authorization": "maybe",
        "contacted_company_ids": [],
        "blocked_companies": [],
        "batch_starts_at": year(start),
        "batch_ends_at": year(2024),
        "added_to_batch_at": year(added),
        "weight": weight,
        "work_experiences": [],
        "educations": [],
        "avatar_url": f"https://faces.example/{i}",
        "latest_position": "",
        "languages": ["Finnish"],
        "shoe_size": 42,
    }
    return {**base, **more}


#: Invented people; what is expected of searches is derived from these values by ``fits``, ``part`` and ``word``.
DOCUMENTS = [
    document(
        31, 2012, 2014, 4,
        desired_roles=[{"role": "Cartographer", "experience": "4..6"}, {"role": "Archivist", "experience": "0..1"}],
        work_locations=["Graz", "Tampere"],
        skills=["Perl", "QGIS3", "Lua+"],
        summary="Draws maps in Perl. Likes terse scripts, F# on Sundays.",
        headline="Patient mapmaker",
        educations=["Applied geodesy"],
        salary_expectations=[[31000, "CHF", "Tampere"], [52000, "CHF", "Graz"]],
        languages=["Finnish", "Welsh"],
    ),
    document(
        32, 2013, 2013, 9,
        accepted=False,
        skills=["Perl", "Lua+", "Solid.js"],
        summary="Perl F# Lua+ maps geodesy",
        headline="Not yet reviewed",
        salary_expectations=[[1000, "CHF", "Graz"]],
    ),
    document(
        33, 2012, 2014, 7,
        desired_work_roles=["Archivist"],
        desired_work_roles_experience=["8+"],
        professional_experience="6..8",
        current_location="Porto",
        work_authorization="granted",
        skills=["COBOL", "Solid.js", "F#"],
        summary="Keeps mainframes alive. Prefers Lua+ over F#, and maps over lists!",
        headline="Patient archivist of COBOL",
        work_experiences=["Signal Box Keeper"],
        contacted_company_ids=[81],
        salary_expectations=[{"minimum": 47000, "maximum": 60000, "currency": "CHF", "city": "Graz"}],
        languages=["Welsh"],
    ),
    document(
        34, 2015, 2016, 1,
        work_locations=["Porto"],
        skills=["Perlite mixing", "Vue.js"],
        summary="Grows plants. Wrote the greenhouse pages in Vue.",
        headline="Greenhouse keeper",
        work_experiences=["Signal Box Keeper", "Gardener"],
        blocked_companies=[82],
        educations=["Applied botany"],
        salary_expectations=[[29000, "CHF", "Porto"]],
    ),
    document(
        35, 2012, 2014, 4,
        professional_experience="6..8",
        work_locations=["Tampere"],
        skills=["QGIS", "Lua+"],
        summary="Surveys lakes; reads old maps",
        headline="Lake surveyor",
        contacted_company_ids=[81, 82],
        salary_expectations=[[None, "CHF", "Tampere"]],
        languages=["Welsh", "Basque"],
    ),
    document(
        36, 2018, 2019, 5,
        skills=["Perl"],
        summary="Starts later",
        headline="Future hand",
        salary_expectations=[[10, "CHF", "Graz"]],
    ),
]


def load(spark, ids):
    rows = [(json.dumps(d),) for d in DOCUMENTS if d["id"] in ids]
    return ingest_profiles(spark.createDataFrame(rows, "value string"))


@pytest.fixture(scope="session")
def tables(spark):
    cache = {}

    def table(*ids):
        if ids not in cache:
            cache[ids] = load(spark, ids).cache()
        return cache[ids]

    return table


@pytest.fixture(scope="session")
def profiles(tables):
    return tables(*(d["id"] for d in DOCUMENTS))
