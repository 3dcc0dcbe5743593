"""Word lists, patterns and name spaces that results depend on."""

from __future__ import annotations

# Fixed values -----------------------------------------------------------------

POSITIVE_WORDS = (
    "good great best love awesome excellent positive support happy success win improve "
    "growth safe"
).split()

NEGATIVE_WORDS = (
    "bad worst hate awful terrible negative angry fail loss risk issue problem crash decline"
).split()

# Stop words of the alphabetic tokenizer.
SHORT_STOPWORDS = (
    "about after all also and any are been before being but can could did does for from had "
    "has have her here him house his how its just more most not now our out she that the "
    "their them there they this too was were what when where which who will with would you "
    "your says new over"
).split()

# The default English list of Spark's StopWordsRemover (a test compares the two).
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd "
    "you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't "
    "didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's "
    "how's let's ought that's there's what's when's where's who's why's would"
).split()

# Fillers of social posts, added to the English list.
SOCIAL_STOPWORDS = (
    "rt amp via http https www com org net co im ive dont didnt doesnt cant couldnt wouldnt "
    "shouldnt youre theyre weve thats its u ur ya lol lmao omg idk btw thx pls okay ok one"
).split()

# Collections of the post/like/follow feed.
POST_COLLECTION = "app.bsky.feed.post"
LIKE_COLLECTION = "app.bsky.feed.like"
FOLLOW_COLLECTION = "app.bsky.graph.follow"

# Forum link patterns, matched on lower-cased text.
VIDEO_EXTENSION = r"\.(mp4|mov|webm|mkv)(\?|$)"
VIDEO_DOMAIN = (
    r"(v\.redd\.it|youtube\.com|youtu\.be|streamable\.com|twitch\.tv|redgifs\.com|gfycat\.com)"
)
IMAGE_EXTENSION = r"\.(jpg|jpeg|png|gif|webp)(\?|$)"
IMAGE_DOMAIN = r"(i\.redd\.it|imgur\.com|flickr\.com|images?)"
VIDEO_HINTS = ["rich:video", "hosted:video", "video"]

# Link fragments that tell the medium of a feed post.
VIDEO_MARKS = r"\.mp4|\.mov|\.webm|video"
IMAGE_MARKS = r"\.jpg|\.jpeg|\.png|\.gif|\.webp|image"

MEDIA_LABELS = ["video", "photo", "text", "other"]

# Punctuation cut from both ends of a sentence word.
EDGE_PUNCTUATION = r""".,!?;:()[]{}"'"""

# Negations of the valence score, and its constants: fixed values of the published VADER lexicon
# method (Hutto and Gilbert, 2014).
NEGATIONS = (
    "aint arent cannot cant couldnt darent despite didnt doesnt dont hadnt hasnt havent isnt "
    "mightnt mustnt neednt neither never none nope nor not nothing nowhere oughtnt rarely "
    "seldom shant shouldnt uhuh wasnt werent without wont wouldnt"
).split()
NEGATION_FACTOR = -0.74
NEGATION_SPAN = 3
VALENCE_ALPHA = 15.0

# Degree words that strengthen or weaken the valence after them, and the published weights.
INTENSIFIERS = (
    "absolutely amazingly awfully completely considerably decidedly deeply enormously entirely "
    "especially exceptionally extremely fabulously flippin flipping frickin fricking friggin "
    "frigging fully greatly hella highly hugely incredibly intensely majorly more most "
    "particularly purely quite really remarkably so substantially thoroughly totally "
    "tremendously uber unbelievably unusually utterly very"
).split()
DAMPENERS = (
    "almost barely hardly kinda kindof kind-of less little marginally occasionally partly "
    "scarcely slightly somewhat sorta sortof sort-of"
).split()
DEGREE_WEIGHT = 0.293
DEGREE_DECAY = (1.0, 0.95, 0.9)
CAPITALS_WEIGHT = 0.733
NEVER_SO_FACTORS = (1.0, 1.5, 1.25)
CONTRAST_FACTORS = (0.5, 1.5)
EXCLAMATION_WEIGHT, MOST_EXCLAMATIONS = 0.292, 4
QUESTION_WEIGHT, MANY_QUESTIONS_WEIGHT = 0.18, 0.96

# RFC 4122 name space for URLs.
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"

# End of fixed values ------------------------------------------------------------


def default_stopwords(extra: list[str] | None = None) -> list[str]:
    """English and social stop words, plus any of the caller's own."""
    return sorted({*ENGLISH_STOPWORDS, *SOCIAL_STOPWORDS, *(extra or [])})
