"""Fixed values that must equal the reference's for equal results.

FIXED VALUES — kept in their natural order, stated plainly.
"""

from __future__ import annotations

# FIXED VALUES: the 22 genre slots of the content vector, in slot order.
GENRES = [
    "Action", "Adventure", "Animation", "Biography", "Comedy", "Crime", "Documentary",
    "Drama", "Family", "Fantasy", "Film-Noir", "History", "Horror", "Music", "Musical",
    "Mystery", "Romance", "Sci-Fi", "Sport", "Thriller", "War", "Western",
]

# FIXED VALUES: upper edges of the year buckets (<=1980, <=1990, <=2000, <=2010, <=2020, later).
YEAR_EDGES = [1980, 1990, 2000, 2010, 2020]

# FIXED VALUES: title types of the content-type filter.
MOVIE_TYPES = ["Movie", "movie", "short"]
TV_TYPES = [
    "TV Series", "TV Mini Series", "TV Movie", "TV Special",
    "tvSeries", "tvMiniSeries", "tvMovie", "tvSpecial",
]

# Test-data binding of content types (part.p_type values), passed as parameters.
TEST_MOVIE_TYPES = ["ECONOMY", "SMALL", "MEDIUM"]
TEST_TV_TYPES = ["STANDARD", "LARGE", "PROMO"]

# FIXED VALUES: column alias lists of the loaders, first present wins.
ID_ALIASES = ["const", "imdb_const", "title_id", "titleid"]
RATING_ALIASES = ["your_rating", "my_rating", "rating"]
DATE_ALIASES = ["date_rated", "created", "timestamp"]
TITLE_ALIASES = ["title"]
YEAR_ALIASES = ["year"]
GENRES_ALIASES = ["genres"]
CROWD_ALIASES = ["imdb_rating", "average_rating"]
VOTES_ALIASES = ["num_votes", "votes"]
TYPE_ALIASES = ["title_type", "titletype"]

# FIXED VALUES: exact-name renames of the raw export (research feature builder).
RAW_EXPORT_RENAMES = {
    "Const": "item_id",
    "Your Rating": "my_rating",
    "Title Type": "title_type",
    "Runtime (mins)": "runtime",
    "IMDb Rating": "imdb_rating",
    "Num Votes": "num_votes",
    "Date Rated": "rated_at",
    "Release Date": "release_date",
}

# FIXED VALUES: item id pattern and the valid rating range.
ITEM_ID_PATTERN = r"^tt\d{7,}$"
RATING_MIN, RATING_MAX = 1, 10

# FIXED VALUES: action names of the action log.
ACTIONS = ["rate", "watchlist_add", "watchlist_remove"]

# FIXED VALUES: stratification bin edges (include_lowest) and even-bin labels.
STRAT_EDGES = [0, 3, 5, 7, 8, 10]
EVEN_EDGES = [0, 2, 4, 6, 8, 10]
EVEN_LABELS = [1, 3, 5, 7, 9]

# FIXED VALUES: explanation texts.
WHY_SEED = "similar to your seed titles"
WHY_HIGH = "predicted high personal rating"
WHY_ALS_DEFAULT = "latent-factor fit from your ratings and IMDb priors"
WHY_BLEND_DEFAULT = "blended score from multiple models"
WHY_ENET = "ElasticNet feature-engineered prediction"

# FIXED VALUES: prediction-quality bands (absolute error upper bounds).
QUALITY_BANDS = [(0.5, "excellent"), (1.0, "good"), (1.5, "fair")]
QUALITY_ELSE, QUALITY_NONE = "poor", "no_prediction"

# FIXED VALUES: imputation defaults when a column is absent, and caps.
DEFAULT_CROWD, DEFAULT_VOTES, DEFAULT_YEAR, DEFAULT_RUNTIME = 7.0, 1000, 2000, 0
VOTES_CAP = 2_000_000

# The evaluation date used instead of "now" in every test query.
AS_OF = "2025-12-31"
