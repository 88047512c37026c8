import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from caseflow.session import get_spark
    s = get_spark("local[*]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s


STATE_CA_OLD = """report_period_start,report_period_end,disease_name,disease_subtype,state,age_group,confirmation_status,count
2024-01-07,2024-01-13,measles,NA,CA,18-24 y,confirmed,999
"""

STATE_CA = """report_period_start,report_period_end,disease_name,disease_subtype,state,geo_name,age_group,confirmation_status,count
2024-01-07,2024-01-13,measles,NA,CA,CA,18-24 y,confirmed,10
2024-01-14,2024-01-20,measles,,CA,CA,25-44 y,confirmed,5
2024-02-04,2024-02-10,measles,,CA,CA,Total,confirmed,15
2024-01-07,2024-01-13,meningococcus,B,CA,CA,unknown,probable,3
2024-01-07,2024-01-13,meningococcus,Not specified,CA,CA,,confirmed,2
"""

STATE_TX = """report_period_start,report_period_end,disease_name,state,geo_name,age_group,count
2024-01-07,2024-01-13,measles,TX,Harris,0-1 y,4
2024-01-21,2024-01-27,measles,TX,Dallas,1-4 y,
"""

WEEKLY_OLD = """Reporting Area,Current MMWR Year,MMWR WEEK,Label,Current week,LOCATION1,LOCATION2
CALIFORNIA,2024,1,Measles,500,CALIFORNIA,
"""

WEEKLY = """Reporting Area,Current MMWR Year,MMWR WEEK,Label,Current week,LOCATION1,LOCATION2
CALIFORNIA,2024,1,Measles,7,CALIFORNIA,
CALIFORNIA,2024,10,Measles,6,CALIFORNIA,
NEW YORK,2024,1,Measles,"1,234",NEW YORK,
ARIZONA,2024,2,"Meningococcal disease, Serogroup B",2,ARIZONA,
ARIZONA,2024,2,"Meningococcal disease, All serogroups",5,ARIZONA,
ARIZONA,2024,2,"Meningococcal disease, Other serogroups",1,ARIZONA,
NEW ENGLAND,2024,1,Measles,9,,New England
US RESIDENTS,2024,1,Measles,20,,
TEXAS,2024,1,Pertussis,-,TEXAS,
"""


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture(scope="session")
def feed_root():
    root = tempfile.mkdtemp(prefix="caseflow-feeds-")
    write(f"{root}/state/data/states/CA/20240101-000000_CA_old.csv", STATE_CA_OLD)
    write(f"{root}/state/data/states/CA/20240301-120000_CA_team.csv", STATE_CA)
    write(f"{root}/state/data/states/TX/20240215-080000_TX_team.csv", STATE_TX)
    write(f"{root}/weekly/NNDSS_Weekly_Data_20240101.csv", WEEKLY_OLD)
    # One upload names the column 'state', another 'reporting_jurisdiction'
    write(f"{root}/mixed/data/states/CA/20240301-120000_CA_team.csv", STATE_CA)
    write(f"{root}/mixed/data/states/TX/20240215-080000_TX_team.csv",
          STATE_TX.replace(",state,", ",reporting_jurisdiction,"))
    write(f"{root}/weekly/NNDSS_Weekly_Data_20240320.csv", WEEKLY)
    return root


@pytest.fixture(scope="session")
def fixture_facts(spark, feed_root):
    from caseflow.operators.conform import load_state_feed, load_weekly_feed
    from caseflow.plans.catalog import load_all
    from caseflow.sources.files import read_state_feed, read_weekly_feed
    loaders = {
        "tracker": lambda s: load_state_feed(read_state_feed(s, f"{feed_root}/state")),
        "nndss": lambda s: load_weekly_feed(read_weekly_feed(s, f"{feed_root}/weekly")),
    }
    facts, report = load_all(spark, loaders)
    return facts.cache()


@pytest.fixture(scope="session")
def fixture_merged(fixture_facts):
    from caseflow.operators.merge import merged_monthly
    return merged_monthly(fixture_facts, plan="conditional").cache()
