"""Word lists and patterns that results depend on, in their natural order."""

# Words left out of an index's keywords.
INDEX_STOPWORDS = """
a an the
i me my myself we our ours ourselves you your yours yourself yourselves
he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those
am is are was were be been being have has had having do does did doing
would should could ought might must shall will can
about above across after against along among around at before behind below beneath beside between beyond
by down during except for from in inside into near of off on onto out outside over past
through throughout to toward under underneath until up upon with within without
and but or nor for yet so because although while if when where whether though unless since
no not only own same than too very just also now here there then once both each few
more most other some such any all every either neither much many how why again ever always
never sometimes often usually really actually
""".split()

# Words left out of a query's keywords.
QUERY_STOPWORDS = """
a an the is are was were be been being have has had do does did will would could should
may might must shall i you we they it he she me him her us them my your his its our their
this that these those what who when where why how which whose and or but if then else so as than
of in on at to for with by from about into through during before after above below between
can tell please know
""".split()

# Words left out of a search over the turn log.
TURN_STOPWORDS = "what is are do does did when where who how my the a an can could would should will you i me your yours tell about remember".split()

# Words left out of a document query's keywords.
RAG_STOPWORDS = """
the a an is are was were be been being have has had do does did will would could should
may might must shall i you he she it we they what which who this that these those
am of in to for on with at by from as into through during and or but if then so than too very just
""".split()

# Capitalised words that name nothing.
QUERY_NOT_NAMES = """
The A An This That These Those What Who When Where Why How Which Whose
I You We They It He She
Monday Tuesday Wednesday Thursday Friday Saturday Sunday
January February March April May June July August September October November December
Is Are Was Were Do Does Did Has Have Can Could Will Would Should Might
Please Tell Show Give Find Get Let Make
""".split()
GRAPH_NOT_NAMES = """
The A An This That I You We They It User Assistant Today Yesterday Tomorrow
Monday Tuesday Wednesday Thursday Friday Saturday Sunday
January February March April May June July August September October November December
""".split()
COMMON_WORDS = """
the a an is was are were be been being have has had do does did will would could should
may might must shall i you we they it this that these those
monday tuesday wednesday thursday friday saturday sunday
january february march april june july august september october november december
""".split()

# Suffix, replacement, least bytes of what is left; the first that fits is taken.
STEM_RULES = (
    ("ization", "ize", 3),
    ("ational", "ate", 3),
    ("fulness", "ful", 3),
    ("ousness", "ous", 3),
    ("iveness", "ive", 3),
    ("tional", "tion", 3),
    ("biliti", "ble", 3),
    ("ement", "", 3),
    ("ness", "", 3),
    ("ment", "", 3),
    ("able", "", 3),
    ("ible", "", 3),
    ("ance", "", 3),
    ("ence", "", 3),
    ("ally", "al", 3),
    ("tion", "", 3),
    ("sion", "", 3),
    ("izer", "ize", 3),
    ("ator", "ate", 3),
    ("ling", "", 3),
    ("ing", "", 3),
    ("ies", "y", 2),
    ("ied", "y", 2),
    ("ion", "", 3),
    ("ity", "", 3),
    ("ful", "", 3),
    ("ous", "", 3),
    ("ive", "", 3),
    ("ess", "", 3),
    ("ist", "", 3),
    ("ism", "", 3),
    ("ial", "", 3),
    ("ual", "", 3),
    ("ly", "", 2),
    ("ed", "", 2),
    ("er", "", 2),
    ("es", "", 2),
    ("'s", "", 2),
    ("s", "", 2),
)

CATEGORIES = ("biographical", "preference", "event", "relationship", "task", "knowledge", "belief", "other")
IMPORTANCE_WORDS = ("important", "remember", "key", "critical", "note", "must")
MALE_NAMES = "john james michael david robert william richard joseph thomas charles daniel matthew anthony mark paul steven andrew joshua kevin brian".split()
FEMALE_NAMES = "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley kimberly emily donna michelle".split()
KIN = "wife|husband|brother|sister|mother|father|friend|colleague|boss|manager"
RELATIVES = "wife|husband|brother|sister|mother|father|mom|dad|son|daughter|friend|colleague|boss|manager"
ORG_SUFFIXES = ("inc", "corp", "llc", "ltd", "company", "co", "group", "foundation")
PLACE_PREFIXES = ("new ", "san ", "los ", "las ", "saint ", "st. ")

# Names: a word with a capital, and one, or any number, more. Under (?i) they take any word.
NAME2 = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
NAMES = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
PLACES = r"([A-Z][a-z]+(?:,?\s+[A-Z][a-z]+)*)"
RELATIONS = (
    ("works_at", 0.8, rf"(?i){NAME2}\s+(?:works at|works for|is employed by|joined)\s+{NAMES}"),
    ("lives_in", 0.8, rf"(?i){NAME2}\s+(?:lives in|is from|moved to|resides in)\s+{PLACES}"),
    ("knows", 0.7, rf"(?i){NAME2}\s+(?:knows|met|befriended)\s+{NAME2}"),
    ("kin", 0.9, rf"(?i){NAME2}\s+is\s+{NAME2}'s\s+({KIN})"),
    ("member_of", 0.75, rf"(?i){NAME2}\s+is\s+(?:a\s+)?(?:member|part)\s+of\s+{NAMES}"),
)
TITLED = rf"(?i)\b(Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s+{NAME2}\b"
MY_RELATIVE = rf"(?i)\bmy\s+({RELATIVES})\s+([A-Z][a-z]+)\b"
COMPANY = rf"(?i)\b{NAMES}\s+(Inc\.?|Corp\.?|LLC|Ltd\.?|Company|Co\.)\b"
LOCATION = rf"(?i)\b(in|at|from|to)\s+{PLACES}\b"
CITY = rf"(?i)\b(in|at|from|to|near)\s+{NAME2}\b"
COUNTRY = r"(?i)\b(USA|UK|US|Canada|Australia|Germany|France|Japan|China|India|Brazil|Mexico|Spain|Italy|Russia)\b"
STATE = r"(?i)\b(California|Texas|Florida|New York|Illinois|Pennsylvania|Ohio|Georgia|Michigan|North Carolina)\b"
PROPER = rf"\b{NAME2}\b"
DATE_YMD = r"\b\d{4}-\d{2}-\d{2}\b"
DATE_MDY = r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"
DATE_WRITTEN = r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{4}\b"
NUMBER = r"\b\d+(?:\.\d+)?%?\b"
CURRENCY = r"\$\d+(?:,\d{3})*(?:\.\d{2})?"
NEGATION = r"(?i)\b(not|no|never|don't|doesn't|didn't|won't|wouldn't|can't|couldn't|shouldn't|isn't|aren't|wasn't|weren't)\b"
QUERY_NEGATION = r"(?i)\b(not|never|no|don't|doesn't|didn't|won't|wouldn't|can't|couldn't|shouldn't|haven't|hasn't|isn't|aren't|wasn't|weren't)\b"
HARD_QUESTION = r"(?i)^\s*(why|how|explain|describe|what.*reason|what.*cause)"
MEDIUM_QUESTION = r"(?i)^\s*(when|where|which|whose)"
EASY_QUESTION = r"(?i)^\s*(what|who|is|are|does|do|did|can|will|has|have)"
TEMPORAL = r"(?i)\b(today|yesterday|tomorrow|last\s+(?:week|month|year)|this\s+(?:week|month|year)|next\s+(?:week|month|year)|ago|\d{4}|january|february|march|april|may|june|july|august|september|october|november|december)\b"
COMPARISON = r"(?i)\b(compare|difference|similar|between|versus|vs\.?|more|less|better|worse|same|different|like|unlike)\b"
CONDITIONAL = r"(?i)\b(if|would|could|might|should|suppose|assuming|hypothetically|imagine)\b"
QUOTED = r"\"[^\"]+\"|'[^']+'"
EXTENSIONS = (".txt", ".md", ".markdown", ".rst", ".json", ".yaml", ".yml", ".csv", ".log", ".html", ".pdf")
