"""Word lists used by the inference and spelling operators.

A ``Lexicons`` value holds small, size-checked vocabularies. The defaults below cover
one region; other regions pass their own lists or read them from tables with
``read_lexicons``. Vocabularies learned from data are tables of their own, see
``operators.library``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.similarity import reachable_lengths

MAX_ENTRIES = 100_000

# Female first names.
FEMALE_NAMES = """
anita asha ashwini archana alka amita ambika aparna aruna avantika
bharati bhagyashri bhavna bimla chanda chandrakala chhaya
deepa deepali devyani durga gauri geeta girija hemlata hira indira indu
jayashri jyoti kalpana kalyani kamala kanchan kavita komal kumari
lata latika laxmi leela madhuri mangala manju manjula meena meenakshi
mohini mona mukta nanda nandini neelam neeta nirmala
padma padmavati parvati pooja prabha priya pushpa
radha rajani rakhi rama rani ratna rekha rohini
sadhana sai sangeeta sarita savita shakuntala shanta shobha shraddha shubhangi
sita sonal sonali sulabha sunita sushama sushila swati usha
vandana vaishali varsha vidya vijaya vimala yamuna yashodabai
bai tai mai jijabai hirabai tarabai radhabai sitabai lilabai godabai nankabai
shantabai urmila pramila parbatabai meerabai prabhabai kamalabai malanbai kantabai kamlabai
santabai jaiwanta pratima anusaya sumitra indubai anusuya anjana vimalabai sevanta
kacharabai rajiya kusumbai shantibai jayawanta kusum savitri manjubai fulanbai
pushpabai raibai nejanbai sangita anjanabai vimalbai shobhabai subhadrabai
parvatibai shashikalabai nirgunabai ruminabai
""".split()

# Male first names.
MALE_NAMES = """
abhijit anil arun ashok atul
baburao balu bapurao bharat bhimrao
chandrakant chandrabhan
dagadu dattatray devrao dilip dinesh
ganesh gangadhar gajanan gajananrao
govind gulab
hari haribhau harishchandra
jagdish janardhan
kailash kishor krishna krushna
laxman lahu
madhav mahendra manoj milind mohan murlidhar
nagesh namdeo narayan narendra
pandurang prabhakar prakash pramod prashant
rajendra ramchandra ramesh ravindra ravi
sadashiv sanjay santosh shivaji shriram
sudhir suresh sunil
trimbak ulhas
vijay vilas vinayak vishnu vitthal
wasudeo yadav yashwant
bhima bhushan chatru dhanu genu
hiraman janu kalu ramu soma tukaram
rajkumar maniram tejram ramdas hemraj
dhanraj premlal kuwarlal gopal hiralal
devendra dayaram mahesh babulal chaitram
dhaniram sadaram ramlal bhojraj khemraj
tarachand omraj nilkanth parasram surendra
rameshwar mohanlal rupchand mayaram shamlal
yograj manohar umesh vinod radheshyam
udaram surajlal vasudev mansaram jageshwar
chunnilal mayalal youraj sukhram
bramhadev pandurang
motiram shankar kisan shalikram harichand ramchand sitaram sundarlal
sankar mukesh jitendra raju shamrao tulshiram kashiram gyaniram
ghanshyam omprakash subhash barikram lakhanlal gendlal nandlal mulchand
maharu yadorao sukhdev atmaram jaipal hivraj dulichand shivlal
bhaiyalal madhukar pyarelal antaram tulsiram rajaram budharam devidas
sukhadev brijlal salikram pralhad shivcharan pramlal purushottam ishwar
ramsing chunilal ankalu sakharam ganeshram shantilal devlal jiyalal
ratiram madanlal ganpat khushal ramcharan radhelal mahadev vasant
gangaram kishan budhram jagannath jagan suraj punaram dhondu
pandhari madan baliram raghunath indrapal nandkishor sukharam umarav
jairam gopichand bhaulal kuvarlal shamrav lakhan vishwanath dipak
dhansay roshan gendalal bhaurao kumarsay lakshman motilal maroti
patiram ramaji ramji insaram devanand baleshwar samaru yuvraj
jagatram vedant vilas youraj
""".split()

# Name endings, tried in this order, female before male.
FEMALE_SUFFIXES = "abai atai amai bai tai mai wati vati devi kali mala lata priya rekha".split()
MALE_SUFFIXES = "rao bhushan anand kant das dev nath singh appa anna bapu bhai".split()

# Surnames by category.
SURNAMES = {
    "sc": """
kamble mang mahar meshram gaikwad raut sonar suryavanshi zade bhalerao
kharat sonkusare dambhare chavhan sonune khandare bharati waghade bankar ingole gedam mohurle
nandeshwar ramteke fulzele tembhare bondre paikrao chawre dahake hatwar nikhade korde umare
jambhulkar dongre
""".split(),
    "st": """
atram madavi markam tekam uike wadde dhurve kumre shyam gavte
netam poyam sori koram maravi pidiya nag dhadde bhende durge kunjam usendi kumeti mandavi tekade
bhatkar narote uikey padvi gavit barse mowade gota pendam lakhe tirke baiga kanoje thakur
""".split(),
    "obc": """
kumbhar sutar lohar mali teli dhangar nhavi pawar jadhav shinde ingle nagpure thakare dhote rathod waghmare
yadav patel kunbi bhoi koli nannaware thakre chavan bansod sable mankar rangari shimpi tamboli bhute
wankhade kalamkar nagrale fulsunge lanjewar ruke bhendarkar deotale mohod borkar ukey kathane tadas
nikhare jamkar bhagat fulkar harde bele
banjara gosavi vaidu laman phanse vanjari dhole kaikadi wadar burud katkar kolhati nandiwale dombari
""".split(),
    "sbc": "vanjare hatkar khatik".split(),
    "pvtg": "kolam katkari madia maria korku".split(),
    "gen": """
deshmukh deshpande kulkarni joshi brahme chitnis panse sathe patil bhosale naik
bhide gokhale apte vaidya phadke kale oak abhyankar damle karmarkar kelkar pendse ranade tilak agashe
atre fadnavis gadgil ghate limaye marathe moghe nene paranjape
""".split(),
}

# Surnames shared by several communities, districts with a tribal majority prior.
AMBIGUOUS_SURNAMES = """
patil naik shinde gaikwad rathod koli chavan pawar jadhav bhosale waghmare dhangar banjara raut dongre thakur
""".split()
TRIBAL_DISTRICTS = """
gadchiroli nandurbar dhule nashik thane palghar amravati yavatmal gondia chandrapur raigad
""".split()

# Further surnames known to the spelling check, and names it must leave alone.
EXTRA_SURNAMES = """
balbudhe mohapure mohanpure nagoshe nikude pendor bhoyar bobade ijpade shende darane pote more
vagh zamre bagath nehare dhanre ruparail madavagade kothekar aaglave borkute mandhare uike dhvas
kamble kambale bele kawade
""".split()
PROTECTED_NAMES = """
govinda govind chandar chandra chandram bhimraj bhimrao shankar shankara omkar omkara vitthal vithal
kailas kailash sudam sudama ramdas ramadas devidas devdas tukaram tukarama namdev namdeo
dnyandev dnyandeo dnyaneshwar eknath brahmananda brahmanand sacchidananda sachchidanand
vijayananda vijayanand shivananda shivanand ananda anand premlal premchand tarachand tarachan
chunnilal chunilal mayalal maialal hemraj himraj youraj yuraj uddal udal ramu rama kalu kala bhura bhuraji
anjanabai anjnabai kamlabai kamaladevi shantabai shantidevi subhadrabai subhadra parvatibai parvatabai
vimalbai vimaladevi shobhabai shobhadevi
pandhare pandhari mandhare mandhari nagoshe nagose nehare nehara dhanre dhanra borkar borker
gharat ghrad madavi madawi markulwar markulvar
""".split()

# The short lists of the quick gender engine.
QUICK_FEMALE_NAMES = """
aarti jijabai akkatai anita parvati sunita meena savita laxmibai sita geeta radha durga shakuntala
rekha usha vandana kavita shobha sneha anjanabai chandrabai devabai indubai jayabai kamlabai parbatabai
""".split()
QUICK_MALE_NAMES = """
ramesh parbata vijay suresh ganesh rajesh mahesh anil sunil pravin ashok bapurao narayan shamrao
dagdu laxman mohan shankar pandurang ramdas devidas
""".split()
QUICK_FEMALE_SUFFIXES = "bai tai wati mati devi kumari".split()
QUICK_MALE_SUFFIXES = "rao das dev ram lal singh".split()


def _bounded(words: Iterable[str], label: str) -> tuple[str, ...]:
    unique = tuple(dict.fromkeys(words))
    if len(unique) > MAX_ENTRIES:
        raise ValueError(f"{label}: {len(unique)} entries; lists beyond {MAX_ENTRIES} belong in a library table")
    return unique


def local_table(spark: SparkSession, columns: dict[str, Sequence], schema: str) -> DataFrame:
    """A small table from driver-side columns."""
    return spark.createDataFrame(pa.table(columns), schema=schema) if columns else spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Lexicons:
    female_names: Sequence[str] = field(default_factory=lambda: FEMALE_NAMES)
    male_names: Sequence[str] = field(default_factory=lambda: MALE_NAMES)
    female_suffixes: Sequence[str] = field(default_factory=lambda: FEMALE_SUFFIXES)
    male_suffixes: Sequence[str] = field(default_factory=lambda: MALE_SUFFIXES)
    surnames: dict[str, Sequence[str]] = field(default_factory=lambda: SURNAMES)
    ambiguous_surnames: Sequence[str] = field(default_factory=lambda: AMBIGUOUS_SURNAMES)
    districts: Sequence[str] = field(default_factory=lambda: TRIBAL_DISTRICTS)
    district_category: str = "st"
    extra_surnames: Sequence[str] = field(default_factory=lambda: EXTRA_SURNAMES)
    protected_names: Sequence[str] = field(default_factory=lambda: PROTECTED_NAMES)

    def first_name_genders(self) -> dict[str, str]:
        """A name on both lists counts as female."""
        genders = {n: "male" for n in _bounded(self.male_names, "male names")}
        genders.update({n: "female" for n in _bounded(self.female_names, "female names")})
        return genders

    def surname_categories(self) -> dict[str, str]:
        pairs = {s: c for c, names in self.surnames.items() for s in names}
        _bounded(pairs, "surnames")
        return pairs

    def first_names(self, spark: SparkSession, name: str = "name", gender: str = "gender") -> DataFrame:
        g = self.first_name_genders()
        return local_table(spark, {name: list(g), gender: list(g.values())}, f"{name} string, {gender} string")

    def surname_table(self, spark: SparkSession, prefix: str = "") -> DataFrame:
        c = self.surname_categories()
        ambiguous = set(self.ambiguous_surnames)
        columns = {
            f"{prefix}surname": list(c),
            f"{prefix}category": list(c.values()),
            f"{prefix}is_ambiguous": [s in ambiguous for s in c],
        }
        return local_table(
            spark, columns, f"{prefix}surname string, {prefix}category string, {prefix}is_ambiguous boolean"
        )

    def spelling_words(self) -> list[tuple[str, str]]:
        """(vocabulary, word): first and middle tokens use 'given', last tokens 'surname'."""
        given = _bounded([*self.female_names, *self.male_names], "first names")
        family = _bounded([*self.surname_categories(), *self.extra_surnames], "surnames")
        return [("given", w) for w in given] + [("surname", w) for w in family]

    def spelling_vocabulary(self, spark: SparkSession) -> DataFrame:
        words = self.spelling_words()
        return local_table(
            spark, {"vocab": [v for v, _ in words], "word": [w for _, w in words]}, "vocab string, word string"
        )


def by_length(spark: SparkSession, words: Sequence[tuple[str, str]], cutoff: float, max_gap: int | None = None) -> DataFrame:
    """(vocab, word, token_length): each word once per token length it can be matched with."""
    rows = [
        (v, w, n)
        for v, w in words
        for n in reachable_lengths(len(w), cutoff)
        if max_gap is None or abs(n - len(w)) <= max_gap
    ]
    return local_table(
        spark,
        {"vocab": [r[0] for r in rows], "word": [r[1] for r in rows], "token_length": [r[2] for r in rows]},
        "vocab string, word string, token_length int",
    )


def read_lexicons(spark: SparkSession, path: str) -> Lexicons:
    """Lexicons from CSV tables with headers in one folder.

    ``first_names.csv`` (name, gender), ``surnames.csv`` (name, category, is_ambiguous),
    ``districts.csv`` (name) and ``protected_names.csv`` (name). Every list is checked
    against MAX_ENTRIES before it reaches the driver.
    """

    def rows(name: str, schema: str):
        table = spark.read.schema(schema).option("header", True).csv(f"{path}/{name}.csv")
        taken = table.limit(MAX_ENTRIES + 1).collect()
        _bounded([str(i) for i in range(len(taken))], name)
        return [r for r in taken if r[0]]

    names = rows("first_names", "name string, gender string")
    families = rows("surnames", "name string, category string, is_ambiguous boolean")
    categories: dict[str, list[str]] = {}
    for r in families:
        categories.setdefault(r["category"], []).append(r["name"].strip().lower())
    return Lexicons(
        female_names=[r["name"].strip().lower() for r in names if r["gender"] == "female"],
        male_names=[r["name"].strip().lower() for r in names if r["gender"] == "male"],
        surnames=categories,
        ambiguous_surnames=[r["name"].strip().lower() for r in families if r["is_ambiguous"]],
        districts=[r["name"].strip().lower() for r in rows("districts", "name string")],
        protected_names=[r["name"].strip().lower() for r in rows("protected_names", "name string")],
    )
