"""Team spellings, built by rule from one row per team."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession

# Code; city; nickname; further codes; further names.
FRANCHISES = """
ARI; Arizona; Cardinals; crd;
ATL; Atlanta; Falcons; ;
BAL; Baltimore; Ravens; rav;
BUF; Buffalo; Bills; ;
CAR; Carolina; Panthers; ;
CHI; Chicago; Bears; ;
CIN; Cincinnati; Bengals; ;
CLE; Cleveland; Browns; ;
DAL; Dallas; Cowboys; ;
DEN; Denver; Broncos; ;
DET; Detroit; Lions; ;
GB; Green Bay; Packers; GNB;
HOU; Houston; Texans; HTX;
IND; Indianapolis; Colts; CLT;
JAX; Jacksonville; Jaguars; JAC;
KC; Kansas City; Chiefs; KAN;
LAC; Los Angeles; Chargers; SDG, SD; LA Chargers, San Diego Chargers
LAR; Los Angeles; Rams; LA, STL, ram; LA Rams, St. Louis Rams, St Louis Rams
LV; Las Vegas; Raiders; OAK, RAI; Oakland, Oakland Raiders
MIA; Miami; Dolphins; ;
MIN; Minnesota; Vikings; ;
NE; New England; Patriots; NWE;
NO; New Orleans; Saints; NOR;
NYG; New York; Giants; ; NY Giants
NYJ; New York; Jets; ; NY Jets
PHI; Philadelphia; Eagles; ;
PIT; Pittsburgh; Steelers; ;
SEA; Seattle; Seahawks; ;
SF; San Francisco; 49ers; SFO;
TB; Tampa Bay; Buccaneers; TAM; Bucs
TEN; Tennessee; Titans; OTI;
WAS; Washington; Commanders; WSH; Washington Football Team
"""


def franchise_aliases(spark: SparkSession) -> DataFrame:
    """``(alias, code)`` for every team: code, further codes, nickname, city with nickname, further
    names, and the city itself where only one team has it.  Matching ignores case."""
    teams = [[part.strip() for part in line.split(";")] for line in FRANCHISES.strip().splitlines()]
    cities = Counter(city for _, city, *_ in teams)
    rows = []
    for code, city, nickname, codes, names in teams:
        spellings = [code, nickname, f"{city} {nickname}", *codes.split(","), *names.split(",")]
        if cities[city] == 1:
            spellings.append(city)
        rows += [(s.strip(), code) for s in spellings if s.strip()]
    return spark.createDataFrame(rows, "alias string, code string")
