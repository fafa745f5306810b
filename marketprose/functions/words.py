"""Word tables and other fixed values the operators take as defaults.

Every operator accepts its own table instead; these are only the seeds.
"""

from __future__ import annotations

# ---- fixed values: stop words ------------------------------------------------
# The widely published 179-word English stop list.
ENGLISH_STOPS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
    he him his himself she she's her hers herself it it's its itself they them their theirs themselves
    what which who whom this that that'll these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on off over
    under again further then once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don don't should should've
    now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
    hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
    shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)

# Added for posts and articles by the cleaning step.
CLEANING_STOPS = tuple(
    """
    rt amp im ive youre weve hes shes its dont cant wont yeah ok okay true haha ha wow cool good great
    thanks thank exactly right love like really much many one thing things today tomorrow yesterday
    time year years people guys
    """.split()
)

# Added by the article keyword report.
KEYWORD_STOPS = tuple(
    "says study company could new year next said like would also think going time one first last know get".split()
)

# Added by the token stage.
TOKEN_STOPS = tuple(
    """
    people think use thing want time work life world way good new year day come look talk right like
    make find need get say take know we i that lot m amp rt
    """.split()
)

# Clitics that a sentence tokenizer splits off, with the stems they leave behind.
CLITIC_STOPS = ("ca", "wo", "sha")

# Left out of the count matrix.
COUNT_STOPS = ("s", "t", "u", "re", "rt", "amp", "know", "don")

# ---- fixed values: protected phrases, rules, splits, inputs ------------------
PROTECTED_PHRASES = (("elon musk", "elon_musk"), ("tesla", "tesla"), ("spacex", "spacex"))

CASE_RULES = (
    ("Tesla/Electric Car", ("Tesla", "electric car", "EV")),
    ("SpaceX/NASA", ("SpaceX", "NASA", "rocket", "astronaut")),
)

SPLIT_RANGES = (
    ("train", "2011-12-01", "2023-12-31"),
    ("val", "2024-01-01", "2024-04-14"),
    ("test", "2024-04-15", "2025-04-14"),
)

TICKERS = ("NVDA", "MSFT", "AAPL", "GOOGL", "AMZN", "META", "AVGO", "TSLA", "JPM")

SEARCH_TERMS = ("elon musk", "tesla", "spacex", "autopilot", "supercharger", "us market", "stock", "economics")

LAGS = (1, 3, 5, 7)

TEXT_COLUMNS = ("content", "fullText", "text", "body")

KEPT_POS = ("NOUN", "PROPN", "ADJ", "VERB", "PRON")

# Code-point ranges erased as emoji. The last one also takes in CJK, kana and Hangul.
EMOJI_RANGES = (
    (0x1F1E0, 0x1F1FF),
    (0x1F300, 0x1F5FF),
    (0x1F600, 0x1F64F),
    (0x1F680, 0x1F6FF),
    (0x1F700, 0x1F77F),
    (0x1F780, 0x1F7FF),
    (0x1F800, 0x1F8FF),
    (0x1F900, 0x1F9FF),
    (0x1FA00, 0x1FA6F),
    (0x1FA70, 0x1FAFF),
    (0x2702, 0x27B0),
    (0x24C2, 0x1F251),
)

# ---- seed word tables --------------------------------------------------------
NOUN_LEMMAS = {
    "media": "medium", "data": "datum", "criteria": "criterion", "phenomena": "phenomenon",
    "men": "man", "women": "woman", "children": "child", "people": "people", "feet": "foot",
    "teeth": "tooth", "mice": "mouse", "geese": "goose", "oxen": "ox", "wolves": "wolf",
    "knives": "knife", "wives": "wife", "lives": "life", "leaves": "leaf", "shelves": "shelf",
    "halves": "half", "thieves": "thief", "loaves": "loaf", "buses": "bus", "gases": "gas",
    "lenses": "lens", "analyses": "analysis", "crises": "crisis", "theses": "thesis",
    "indices": "index", "matrices": "matrix", "vertices": "vertex", "heroes": "hero",
    "potatoes": "potato", "tomatoes": "tomato", "echoes": "echo", "vetoes": "veto",
    "movies": "movie", "species": "species", "series": "series", "news": "news",
    "lens": "lens", "always": "always", "perhaps": "perhaps", "physics": "physics",
    "economics": "economics", "politics": "politics", "mathematics": "mathematics",
    "spacemen": "spaceman", "businessmen": "businessman", "policemen": "policeman",
}

VERB_LEMMAS = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be",
    "has": "have", "had": "have", "having": "have", "does": "do", "did": "do", "done": "do",
    "doing": "do", "goes": "go", "went": "go", "gone": "go", "going": "go", "said": "say",
    "says": "say", "saying": "say", "made": "make", "making": "make", "took": "take",
    "taken": "take", "taking": "take", "came": "come", "coming": "come", "got": "get",
    "getting": "get", "gets": "get", "knew": "know", "known": "know", "thought": "think",
    "bought": "buy", "sold": "sell", "built": "build", "grew": "grow", "grown": "grow",
    "fell": "fall", "fallen": "fall", "rose": "rise", "risen": "rise", "wrote": "write",
    "written": "write", "ran": "run", "running": "run", "told": "tell", "found": "find",
    "gave": "give", "given": "give", "saw": "see", "seen": "see", "won": "win", "lost": "lose",
    "paid": "pay", "met": "meet", "led": "lead", "left": "leave", "kept": "keep", "held": "hold",
    "licensed": "license", "using": "use", "used": "use", "moving": "move", "moved": "move",
    "driving": "drive", "drove": "drive", "driven": "drive", "flew": "fly", "flown": "fly",
}

POS_WORDS = {
    "PRON": tuple(
        """
        i me my mine myself we us our ours ourselves you your yours yourself yourselves he him his
        himself she her hers herself it its itself they them their theirs themselves who whom whose
        what something anything nothing everything someone anyone everyone nobody
        """.split()
    ),
    "DET": ("the", "a", "an", "this", "that", "these", "those", "each", "every", "some", "any", "no", "all", "both"),
    "ADP": tuple(
        """
        of in to for with on at from by about as into like through after over between out against
        during without before under around among per via upon within toward towards off
        """.split()
    ),
    "CCONJ": ("and", "or", "but", "nor", "yet"),
    "SCONJ": ("if", "because", "while", "although", "though", "whether", "since", "unless", "than", "until"),
    "AUX": tuple(
        """
        am is are was were be been being has have had do does did will would can could shall should
        may might must
        """.split()
    ),
    "PART": ("not", "s", "t", "n"),
    "ADV": tuple(
        """
        very too also just now then here there when where why how never ever always often soon still
        already again once only even almost quite rather perhaps maybe well
        """.split()
    ),
    "VERB": tuple(
        """
        go goes went get gets got make makes made take takes took come comes came say says said know
        knows think thinks see sees saw give gives gave find finds found tell tells told buy buys
        bought sell sells sold build builds built run runs ran rise rises rose fall falls fell grow
        grows grew write writes wrote visit visits keep keeps kept become becomes became want wants
        need needs try tries ask asks seem seems feel feels leave leaves
        """.split()
    ),
    "ADJ": tuple(
        """
        new good great big small high low old young long short early late large own other same
        different public bad free real best better worse worst strong weak hot cold fast slow rich
        poor amazing electric autonomous legal global local major minor worthless stupid happy sad
        """.split()
    ),
}

# Ordered ending rules for words outside POS_WORDS; what matches none is a noun.
POS_ENDINGS = (
    (("ly",), 4, "ADV"),
    (("ing", "ed"), 5, "VERB"),
    (("ous", "ful", "able", "ible", "ish", "less"), 5, "ADJ"),
)

# Valence seed, on the published -4..4 scale.
VALENCE = {
    "abuse": -3.2, "accident": -2.1, "admire": 2.1, "afraid": -2.0, "agree": 1.5, "alarm": -1.4,
    "amazing": 2.8, "anger": -2.7, "angry": -2.3, "annoy": -1.9, "awesome": 3.1, "awful": -2.0,
    "bad": -2.5, "beautiful": 2.9, "benefit": 2.0, "best": 3.2, "better": 1.9, "bless": 1.8,
    "boring": -1.3, "brave": 2.4, "bright": 1.9, "brilliant": 2.8, "broken": -2.1, "care": 2.2,
    "celebrate": 2.7, "clever": 2.0, "confident": 2.2, "cool": 1.3, "corrupt": -3.2, "crash": -1.7,
    "crazy": -1.4, "crime": -2.5, "crisis": -3.1, "cry": -2.1, "damage": -2.2, "danger": -2.4,
    "dead": -3.3, "death": -2.9, "defeat": -2.0, "delight": 2.9, "destroy": -2.5, "die": -2.9,
    "dirty": -1.9, "disaster": -3.1, "dumb": -2.3, "easy": 1.9, "enemy": -2.5, "enjoy": 2.2,
    "evil": -3.4, "excellent": 2.7, "excited": 1.4, "fail": -2.5, "failure": -2.3, "fake": -2.1,
    "fantastic": 2.6, "fear": -2.2, "fine": 0.8, "fraud": -2.8, "free": 2.3, "friend": 2.2,
    "fun": 2.3, "funny": 1.9, "gain": 2.4, "glad": 2.0, "good": 1.9, "great": 3.1, "grief": -2.2,
    "happy": 2.7, "harm": -2.5, "hate": -2.7, "help": 1.7, "hero": 2.6, "honest": 2.3, "hope": 1.9,
    "horrible": -2.5, "hurt": -2.4, "idiot": -2.3, "ill": -1.8, "improve": 1.9, "innovative": 1.9,
    "joy": 2.8, "kill": -3.7, "kind": 2.4, "lazy": -1.5, "liar": -2.3, "lie": -1.6, "like": 1.5,
    "lol": 1.8, "lose": -1.7, "loss": -1.3, "lost": -1.3, "love": 3.2, "lucky": 1.8, "mad": -2.2,
    "mess": -1.5, "murder": -3.7, "nice": 1.8, "pain": -2.3, "panic": -2.3, "peace": 2.5,
    "perfect": 2.7, "poor": -2.1, "positive": 2.6, "problem": -1.7, "profit": 1.9, "proud": 2.1,
    "rich": 2.6, "risk": -1.1, "sad": -2.1, "safe": 1.9, "scam": -2.7, "smart": 1.7, "smile": 1.5,
    "strong": 2.3, "stupid": -2.4, "success": 2.7, "support": 1.7, "terrible": -2.1, "thank": 1.5,
    "thanks": 1.9, "threat": -2.4, "trouble": -1.7, "true": 1.8, "trust": 2.3, "ugly": -2.3,
    "useful": 1.9, "useless": -1.8, "victory": 2.7, "violence": -3.1, "war": -2.9, "weak": -1.9,
    "win": 2.8, "wonderful": 2.7, "worry": -1.9, "worse": -2.1, "worst": -3.1, "worthless": -1.9,
    "wow": 2.8, "wrong": -2.1, "yes": 1.7,
}

# ---- fixed values: sentiment rules of the published method -------------------
BOOST = 0.293
CAPS_BOOST = 0.733
NEGATION = -0.74
NORMAL_ALPHA = 15.0
DAMPING = (1.0, 0.95, 0.9)

BOOST_UP = tuple(
    """
    absolutely amazingly awfully completely considerably decidedly deeply enormously entirely
    especially exceptionally extremely fabulously flipping frigging fully greatly hella highly hugely
    incredibly intensely majorly more most particularly purely quite really remarkably so
    substantially thoroughly totally tremendously uber unbelievably unusually utterly very
    """.split()
)
BOOST_DOWN = tuple(
    "almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split()
)
BOOST_DOWN_PHRASES = ("just enough", "kind of", "sort of")
NEGATIONS = tuple(
    """
    aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't
    doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't
    mightn't mustn't neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt
    uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't
    wouldn't rarely seldom despite
    """.split()
)
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "cut the mustard": 2.0,
    "kiss of death": -1.5, "hand to mouth": -2.0,
}
