"""Word lists, category names and parameters that results depend on."""

# Spark's default English stop words.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what
which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for
with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd
he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought
that's there's what's when's where's who's why's would
""".split()

# Ratings a labelled film may carry.
VALID_RATINGS = ["R", "PG-13", "PG", "G", "NC-17"]

# Every rating that was ever in use.
ALL_RATINGS = ["G", "PG", "PG-13", "R", "NC-17", "X", "GP", "M", "M/PG"]

# Out-of-use ratings and the current rating they became; ratings too rare to learn.
RENAMED_RATINGS = {"GP": "PG", "M": "PG", "M/PG": "PG"}
RARE_RATINGS = ["NC-17", "X"]

# Single words that deny any sensitive content.
DENIALS = ["none", "nothing", "nil", "na", "no", "non", "nope", "nada"]

# Conversion fields of a subtitle file that are kept as metadata.
CONVERSION_FIELDS = ["sentences", "tokens", "unknown_words", "truecased_words"]

# Guide sections and the rating dimensions they describe.
GUIDE_CATEGORIES = {
    "alcohol_drugs_smoking": "DRUGS",
    "violence_gore": "VIOLENCE",
    "sex_nudity": "NUDITY",
    "profanity": "PROFANITY",
    "frightening_intense_scenes": "SCARY",
}

# Defaults of the feature and model stages.
NUM_FEATURES = 10000
MIN_DOC_FREQ = 2
SEARCH_MIN_DOC_FREQ = 20
SEARCH_NUM_FEATURES = 5000
SEARCH_LAYERS = [[5000, 2056, 512, 128, 2], [5000, 1000, 128, 2], [5000, 100, 2], [5000, 5000, 2]]
BLEND_FOLDS = 5
SCORE_FOLDS = 3
TITLE_CUTOFF = 0.6
VECTOR_DISTANCE = 0.09
