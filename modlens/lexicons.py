"""Fixed word lists, patterns and parameters.

Every operator takes its lists as an argument; the values here are the defaults.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Identity terms by category.
IDENTITY_TERMS: dict[str, list[str]] = {
    "gender": [
        "woman", "man", "transgender", "girl", "boy", "female", "male", "lgbt", "gay",
        "lesbian", "bisexual", "queer", "straight", "homosexual",
    ],
    "race_ethnicity": [
        "black", "white", "asian", "hispanic", "latino", "latina", "native", "african",
        "european", "middle eastern", "jewish", "muslim", "islamic",
    ],
    "religion": [
        "christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic",
        "protestant", "sikh", "religious", "secular",
    ],
    "age": [
        "young", "old", "elderly", "teen", "teenage", "adult", "senior", "millennial",
        "boomer", "generation",
    ],
    "disability": ["disabled", "handicapped", "blind", "deaf", "autistic", "wheelchair"],
}

# Shorthand, first and second pass.
TYPOS: list[tuple[str, str]] = [
    ("w/e", "whatever"),
    ("usagov", "usa government"),
    ("recentlu", "recently"),
    ("ph0tos", "photos"),
    ("amirite", "am i right"),
    ("exp0sed", "exposed"),
    ("<3", "love"),
    ("luv", "love"),
    ("amageddon", "armageddon"),
    ("trfc", "traffic"),
    ("16yr", "16 year"),
]
ACRONYMS: list[tuple[str, str]] = [("2mw", "tomorrow")]
# Shorthand, third pass, in the order in which the keys are tried.
ABBREVIATIONS: list[tuple[str, str]] = [
    ("$", " dollar "),
    ("€", " euro "),
    ("4ao", "for adults only"),
    ("a.m", "before midday"),
    ("a3", "anytime anywhere anyplace"),
    ("aamof", "as a matter of fact"),
    ("acct", "account"),
    ("adih", "another day in hell"),
    ("afaic", "as far as i am concerned"),
    ("afaict", "as far as i can tell"),
    ("afaik", "as far as i know"),
    ("afair", "as far as i remember"),
    ("afk", "away from keyboard"),
    ("app", "application"),
    ("approx", "approximately"),
    ("apps", "applications"),
    ("asap", "as soon as possible"),
    ("asl", "age, sex, location"),
    ("atk", "at the keyboard"),
    ("ave.", "avenue"),
    ("aymm", "are you my mother"),
    ("ayor", "at your own risk"),
    ("b&b", "bed and breakfast"),
    ("b+b", "bed and breakfast"),
    ("b.c", "before christ"),
    ("b2b", "business to business"),
    ("b2c", "business to customer"),
    ("b4", "before"),
    ("b4n", "bye for now"),
    ("b@u", "back at you"),
    ("bae", "before anyone else"),
    ("bak", "back at keyboard"),
    ("bbbg", "bye bye be good"),
    ("bbc", "british broadcasting corporation"),
    ("bbias", "be back in a second"),
    ("bbl", "be back later"),
    ("bbs", "be back soon"),
    ("be4", "before"),
    ("bfn", "bye for now"),
    ("blvd", "boulevard"),
    ("bout", "about"),
    ("brb", "be right back"),
    ("bros", "brothers"),
    ("brt", "be right there"),
    ("bsaaw", "big smile and a wink"),
    ("btw", "by the way"),
    ("bwl", "bursting with laughter"),
    ("c/o", "care of"),
    ("cet", "central european time"),
    ("cf", "compare"),
    ("cia", "central intelligence agency"),
    ("csl", "can not stop laughing"),
    ("cu", "see you"),
    ("cul8r", "see you later"),
    ("cv", "curriculum vitae"),
    ("cwot", "complete waste of time"),
    ("cya", "see you"),
    ("cyt", "see you tomorrow"),
    ("dae", "does anyone else"),
    ("dbmib", "do not bother me i am busy"),
    ("diy", "do it yourself"),
    ("dm", "direct message"),
    ("dwh", "during work hours"),
    ("e123", "easy as one two three"),
    ("eet", "eastern european time"),
    ("eg", "example"),
    ("embm", "early morning business meeting"),
    ("encl", "enclosed"),
    ("encl.", "enclosed"),
    ("etc", "and so on"),
    ("faq", "frequently asked questions"),
    ("fawc", "for anyone who cares"),
    ("fb", "facebook"),
    ("fc", "fingers crossed"),
    ("fig", "figure"),
    ("fimh", "forever in my heart"),
    ("ft.", "feet"),
    ("ft", "featuring"),
    ("ftl", "for the loss"),
    ("ftw", "for the win"),
    ("fwiw", "for what it is worth"),
    ("fyi", "for your information"),
    ("g9", "genius"),
    ("gahoy", "get a hold of yourself"),
    ("gal", "get a life"),
    ("gcse", "general certificate of secondary education"),
    ("gfn", "gone for now"),
    ("gg", "good game"),
    ("gl", "good luck"),
    ("glhf", "good luck have fun"),
    ("gmt", "greenwich mean time"),
    ("gmta", "great minds think alike"),
    ("gn", "good night"),
    ("g.o.a.t", "greatest of all time"),
    ("goat", "greatest of all time"),
    ("goi", "get over it"),
    ("gps", "global positioning system"),
    ("gr8", "great"),
    ("gratz", "congratulations"),
    ("gyal", "girl"),
    ("h&c", "hot and cold"),
    ("hp", "horsepower"),
    ("hr", "hour"),
    ("hrh", "his royal highness"),
    ("ht", "height"),
    ("ibrb", "i will be right back"),
    ("ic", "i see"),
    ("icq", "i seek you"),
    ("icymi", "in case you missed it"),
    ("idc", "i do not care"),
    ("idgadf", "i do not give a damn fuck"),
    ("idgaf", "i do not give a fuck"),
    ("idk", "i do not know"),
    ("ie", "that is"),
    ("i.e", "that is"),
    ("ifyp", "i feel your pain"),
    ("IG", "instagram"),
    ("iirc", "if i remember correctly"),
    ("ilu", "i love you"),
    ("ily", "i love you"),
    ("imho", "in my humble opinion"),
    ("imo", "in my opinion"),
    ("imu", "i miss you"),
    ("iow", "in other words"),
    ("irl", "in real life"),
    ("j4f", "just for fun"),
    ("jic", "just in case"),
    ("jk", "just kidding"),
    ("jsyk", "just so you know"),
    ("l8r", "later"),
    ("lb", "pound"),
    ("lbs", "pounds"),
    ("ldr", "long distance relationship"),
    ("lmao", "laugh my ass off"),
    ("lmfao", "laugh my fucking ass off"),
    ("lol", "laughing out loud"),
    ("ltd", "limited"),
    ("ltns", "long time no see"),
    ("m8", "mate"),
    ("mf", "motherfucker"),
    ("mfs", "motherfuckers"),
    ("mfw", "my face when"),
    ("mofo", "motherfucker"),
    ("mph", "miles per hour"),
    ("mr", "mister"),
    ("mrw", "my reaction when"),
    ("ms", "miss"),
    ("mte", "my thoughts exactly"),
    ("nagi", "not a good idea"),
    ("nbc", "national broadcasting company"),
    ("nbd", "not big deal"),
    ("nfs", "not for sale"),
    ("ngl", "not going to lie"),
    ("nhs", "national health service"),
    ("nrn", "no reply necessary"),
    ("nsfl", "not safe for life"),
    ("nsfw", "not safe for work"),
    ("nth", "nice to have"),
    ("nvr", "never"),
    ("nyc", "new york city"),
    ("oc", "original content"),
    ("og", "original"),
    ("ohp", "overhead projector"),
    ("oic", "oh i see"),
    ("omdb", "over my dead body"),
    ("omg", "oh my god"),
    ("omw", "on my way"),
    ("p.a", "per annum"),
    ("p.m", "after midday"),
    ("pm", "prime minister"),
    ("poc", "people of color"),
    ("pov", "point of view"),
    ("pp", "pages"),
    ("ppl", "people"),
    ("prw", "parents are watching"),
    ("ps", "postscript"),
    ("pt", "point"),
    ("ptb", "please text back"),
    ("pto", "please turn over"),
    ("qpsa", "what happens"),
    ("ratchet", "rude"),
    ("rbtl", "read between the lines"),
    ("rlrt", "real life retweet"),
    ("rofl", "rolling on the floor laughing"),
    ("roflol", "rolling on the floor laughing out loud"),
    ("rotflmao", "rolling on the floor laughing my ass off"),
    ("rt", "retweet"),
    ("ruok", "are you ok"),
    ("sfw", "safe for work"),
    ("sk8", "skate"),
    ("smh", "shake my head"),
    ("sq", "square"),
    ("srsly", "seriously"),
    ("ssdd", "same stuff different day"),
    ("tbh", "to be honest"),
    ("tbs", "tablespooful"),
    ("tbsp", "tablespooful"),
    ("tfw", "that feeling when"),
    ("thks", "thank you"),
    ("tho", "though"),
    ("thx", "thank you"),
    ("tia", "thanks in advance"),
    ("til", "today i learned"),
    ("tl;dr", "too long i did not read"),
    ("tldr", "too long i did not read"),
    ("tmb", "tweet me back"),
    ("tntl", "trying not to laugh"),
    ("ttyl", "talk to you later"),
    ("u", "you"),
    ("u2", "you too"),
    ("u4e", "yours for ever"),
    ("utc", "coordinated universal time"),
    ("w/", "with"),
    ("w/o", "without"),
    ("w8", "wait"),
    ("wassup", "what is up"),
    ("wb", "welcome back"),
    ("wtf", "what the fuck"),
    ("wtg", "way to go"),
    ("wtpa", "where the party at"),
    ("wuf", "where are you from"),
    ("wuzup", "what is up"),
    ("wywh", "wish you were here"),
    ("yd", "yard"),
    ("ygtr", "you got that right"),
    ("ynk", "you never know"),
    ("zzz", "sleeping bored and tired"),
]

SUBSTITUTION_PASSES: list[list[tuple[str, str]]] = [TYPOS, ACRONYMS, ABBREVIATIONS]

# Negation triggers. The apostrophe is optional in the second list.
NEGATION_WORDS: list[str] = [
    "not", "no", "never", "none", "neither", "nowhere", "nobody", "nothing", "n't", "cannot",
]
NEGATION_CONTRACTIONS: list[str] = [
    "can't", "won't", "wouldn't", "shouldn't", "couldn't", "don't", "doesn't", "isn't",
    "aren't", "ain't",
]

# Tokens that close a negation scope.
SCOPE_TERMINATORS: list[str] = [
    ".", "!", "?", ",", ";", "but", "however", "nevertheless", "yet", "although", "though",
    "still", "instead",
]

# Words that are never marked as negated.
NON_NEGATABLE: list[str] = [
    "i", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "can", "could", "will", "would", "shall", "should", "may", "might", "must",
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to",
]
NEGATION_PREFIX = "NOT_"

# Polarity words.
NEGATIVE_WORDS: list[str] = [
    "bad", "hate", "wrong", "stupid", "idiot", "terrible", "awful", "horrible", "disgusting",
    "pathetic", "worthless", "evil", "angry", "furious", "offensive", "ignorant", "cruel",
    "negative", "poor", "worst", "weak", "reject", "failure", "fail", "suck", "inferior",
    "incompetent",
]
POSITIVE_WORDS: list[str] = [
    "good", "love", "great", "nice", "kind", "wonderful", "excellent", "amazing", "fantastic",
    "brilliant", "beautiful", "helpful", "friendly", "positive", "respect", "support",
    "appreciate", "superior", "competent", "capable", "skilled", "talented",
]

# Aggressive, generalising and emotion words.
AGGRESSIVE_WORDS: list[str] = [
    "stupid", "idiot", "dumb", "moron", "fool", "retard", "loser", "worthless", "pathetic",
    "trash", "garbage",
]
GENERALIZING_WORDS: list[str] = ["all", "every", "always", "never"]
SECOND_PERSON_WORDS: list[str] = ["you", "your", "you're"]
EMOTION_WORDS: dict[str, list[str]] = {
    "anger": ["angry", "furious", "mad", "rage", "hatred"],
    "disgust": ["disgusting", "gross", "revolting", "sick"],
    "fear": ["scared", "terrified", "afraid", "frightened"],
    "joy": ["happy", "excited", "glad", "pleased"],
    "sadness": ["sad", "depressed", "unhappy", "miserable"],
}

# Phrase patterns, matched on lower-cased text.
STEREOTYPE_PATTERNS: list[str] = [
    "all of them are",
    "they always",
    "these people",
    r"(typical|always|every) \w+ (person|people)",
]
# The hate pattern in its parts, which are searched by their rarest words first.
HATE_PHRASES: list[str] = ["go back to", "you people", "you all are"]
HATE_TRIGGERS: list[str] = ["hate", "despise", "can't stand"]
HATE_TARGETS: list[str] = ["people", "group", "community"]
BIAS_PATTERNS: dict[str, str] = {
    "targeted_hate": r"(?:all|every|typical|always|these)\s+(?:{terms})",
    "stereotyping": r"(?:you|they|these)\s+(?:people|folks|ones)\s+are",
    "us_vs_them": r"(?:these|those|you)\s+(?:people|ones|type)",
    "derogatory": "stupid|dumb|idiot|moron",
}

# URL and e-mail patterns.
EMAIL_CHARS = r"a-z0-9.\-+_"

# Labels and their tuning parameters
# (label, threshold range low, high, weight multiplier, focal alpha).
LABELS: list[str] = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]
LABEL_PARAMS: list[tuple[str, float, float, float, float]] = [
    ("toxic", 0.3, 0.7, 2.0, 0.25),
    ("severe_toxic", 0.4, 0.8, 3.0, 0.3),
    ("threat", 0.3, 0.5, 2.5, 0.4),
    ("identity_hate", 0.6, 0.8, 1.5, 0.35),
    ("obscene", 0.4, 0.7, 2.0, 0.25),
    ("insult", 0.4, 0.7, 2.0, 0.25),
]
THRESHOLD_STEP = 0.05

# Confidence bins, right-closed.
CONFIDENCE_BINS: list[tuple[float, float, str]] = [
    (0.0, 0.2, "Very Low"),
    (0.2, 0.4, "Low"),
    (0.4, 0.6, "Moderate"),
    (0.6, 0.8, "High"),
    (0.8, 1.0, "Very High"),
]

# Model inputs of the manual-feature forest.
FEATURE_COLUMNS: list[str] = [
    "word_count", "avg_word_length", "sentence_count", "uppercase_ratio", "punctuation_ratio",
    "personal_attack_score", "hate_pattern_count", "aggressive_word_ratio",
    "stereotype_pattern_count", "generalization_ratio",
    "verb_ratio", "adj_ratio", "adv_ratio", "pronoun_ratio", "imperative_count",
    "anger_ratio", "disgust_ratio", "fear_ratio", "joy_ratio", "sadness_ratio",
    "identity_term_count", "has_identity_terms", "identity_context_sentiment",
    "gender_mentions", "race_ethnicity_mentions", "religion_mentions", "age_mentions",
    "disability_mentions",
    "negation_count", "identity_in_negation", "identity_positive_context",
    "identity_negative_context",
]
# ---------------------------------------------------------------------------


def distinct_terms(lexicon: dict[str, list[str]]) -> list[str]:
    """All terms of a lexicon, lower-cased, each once, sorted."""
    return sorted({t.lower() for terms in lexicon.values() for t in terms})
