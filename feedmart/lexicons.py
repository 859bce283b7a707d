"""Word lists, patterns, weights and the source registry: defaults that any call may replace.

The values in this module are fixed values: results depend on them exactly.
"""

from __future__ import annotations

TIME_ZONE = "America/Los_Angeles"

#: Words that an index never holds. Fixed values.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might can "
    "this that these those it its about as into through during before after up down out off over under then once how what when where who which event events "
    "more near our their your my all each every both few most other some such than too very also just only even here there no not so if us uc berkeley campus university"
).split()

#: Words that a title's dedupe key leaves out. Fixed values.
DEDUPE_STOP_WORDS = "a an the and or of in on at to for with by from is as vs vs. &".split()

CATEGORIES = ["Academic", "Arts", "Sports", "Science & Tech", "Student Life", "Entrepreneurship"]
DEFAULT_CATEGORY = "Student Life"

#: Search words and what they also stand for. Fixed values.
SYNONYMS = {
    "startup": ["entrepreneurship", "founder", "venture", "pitch", "skydeck"],
    "founder": ["startup", "entrepreneur", "venture", "pitch"],
    "venture": ["startup", "founder", "entrepreneur"],
    "film": ["movie", "screening", "cinema", "documentary"],
    "movie": ["film", "screening", "cinema"],
    "concert": ["music", "recital", "performance", "band", "orchestra"],
    "music": ["concert", "recital", "performance"],
    "talk": ["lecture", "seminar", "speaker", "panel", "discussion", "colloquium"],
    "lecture": ["talk", "seminar", "speaker", "panel"],
    "seminar": ["talk", "lecture", "speaker", "panel"],
    "workshop": ["class", "training", "hands-on", "session"],
    "career fair": ["job fair", "recruiting fair", "internship fair"],
    "career": ["job", "recruiting", "internship", "networking"],
    "networking": ["career", "job", "professional", "mixer", "reception"],
    "free food": ["pizza", "snacks", "refreshments", "reception", "lunch", "dinner"],
    "fun": ["social", "performance", "game", "festival", "party", "arts"],
    "interesting": ["talk", "lecture", "workshop", "exhibition", "seminar"],
    "code": ["programming", "hackathon", "engineering", "software", "cs"],
    "coding": ["programming", "hackathon", "engineering", "software", "cs"],
    "ai": ["artificial intelligence", "machine learning", "language model", "llm"],
    "artificial intelligence": ["ai", "machine learning", "language model", "llm"],
    "game": ["basketball", "football", "baseball", "volleyball", "soccer", "athletics"],
    "sports": ["athletics", "basketball", "football", "baseball", "volleyball"],
}

#: Places and the words they add to an index and to a query. Fixed values.
VENUE_ALIASES = {
    "bampfa": "bampfa film museum cinema",
    "moffitt": "moffitt",
    "doe library": "doe library",
    "mlk": "student union meeting",
    "rsf": "gym fitness recreation sports wellness",
    "haas": "business school management haas",
    "sproul": "plaza outdoor student",
    "memorial glade": "outdoor event lawn",
    "soda": "computer science engineering cs",
    "cory hall": "electrical engineering eecs",
    "eecs": "electrical engineering computer science",
    "cdss": "data science computing statistics",
    "graduate division": "graduate student academic",
    "stanley hall": "biology bioengineering health",
    "mulford hall": "environmental science biology",
    "dwinelle": "humanities languages",
    "wheeler": "english history humanities",
    "northside": "north campus residential",
    "southside": "south campus telegraph",
}

#: Phrases whose occurrence raises a score. Fixed values.
KNOWN_PHRASES = [
    "free food", "film screening", "career fair", "startup founder", "guest speaker", "study group", "coffee chat", "info session",
    "open house", "demo day", "tech talk", "research talk", "panel discussion", "happy hour", "game night", "networking event",
    "dissertation defense", "job fair", "book club", "startup pitch", "venture capital", "data science", "machine learning",
]

#: Tokens that are never matched loosely, and tokens of one topic. Fixed values.
STRICT_TOKENS = "basketball football baseball volleyball soccer tennis gymnastic rowing hackathon moffitt bampfa haas simons eecs cdss".split()
AI_TOKENS = "ai artificial intelligence machine learn language model llm".split()
AI_PATTERN = "ai|artificial intelligence|machine learning|language models?|llm"

#: Greatest distance of a loose match, and rows that a loose pass gives. Fixed values.
LOOSE, LOOSE_ROWS = 0.38, 100

#: Weights of index fields and of what else raises a score. Fixed values.
FIELD_WEIGHTS = {"t": 60.0, "g": 45.0, "o": 30.0, "l": 20.0, "d": 10.0}
FIELD_ORDER = "tgold"
TITLE_PHRASE, PHRASE, RECENCY, RECENCY_DAYS, CATEGORY_BOOST, SYNONYM_SHARE = 100.0, 70.0, 15.0, 30, 25.0, 0.55
#: (share of rows above which, multiplier), then the share below which a token is rare and its multiplier. Fixed values.
FREQUENCY_BANDS = [(0.3, 0.2), (0.15, 0.4), (0.08, 0.65)]
RARE_SHARE, RARE_MULTIPLIER = 0.01, 1.15

#: Intent patterns, each between word boundaries; first match of a list wins. Fixed values.
TEMPORAL = [
    ("tonight", "tonight|this evening"),
    ("today", "today|this afternoon|this morning"),
    ("tomorrow", "tomorrow|tmrw|tmr"),
    ("weekend", "this weekend|weekend"),
    ("week", "this week|next 7 days"),
    ("upcoming", "upcoming|next month|coming up|soon"),
]
TIMES_OF_DAY = [
    ("morning", "this morning|morning|breakfast|early morning"),
    ("afternoon", "this afternoon|afternoon|lunch|midday|after class|after lunch|noon"),
    ("evening", "tonight|this evening|evening|after work|after 5|nighttime|night"),
]
ONLINE, ONLINE_TEXT, IN_PERSON = "online|virtual|zoom|remote|webinar|livestream", "online|virtual|zoom|remote|webinar", "in.?person|on campus"
FREE_THINGS = "admission|entry|event|events|food|lunch|dinner|pizza|snacks|refreshments|ticket|tickets|screening|workshop|concert"
NOT_FREE_QUERY, NOT_FREE_TEXT = "throw|agent|range|radical|speech", "throw|agent|range|radical|speech|will"
SPORT_GAMES = "cal games?|bears games?|cal bears games?"
CATEGORY_PATTERNS = [
    ("Entrepreneurship", "startup|founder|venture|pitch|demo day|skydeck|entrepreneur|entrepreneurship|product management|innovation hub"),
    ("Sports", "cal games?|bears games?|cal bears|athletics|basketball|football|baseball|volleyball|soccer|swim meet|swim team|tennis|gymnastics|rowing|crew|sports"),
    ("Arts", "arts?|film screening|film|movie|concert|performance|theater|theatre|gallery|bampfa|dance|opera|recital|exhibition|exhibit|museum|poetry"),
    ("Science & Tech", r"science(?:\s*&\s*tech)?|tech(?:nology)?|ai|artificial intelligence|machine learning|language models?|llm|data science|hackathon|coding|computer science|eecs|engineering talk|robotics|biotech|genomics|tech talk"),
    ("Student Life", "student life|free food|student org|club|social|mixer|orientation|undergrad|grad student|tabling|info session|open house|coffee chat"),
    ("Academic", "academic|seminar|colloquium|lecture|symposium|dissertation defense|dissertation|thesis defense|guest speaker|research talk|keynote"),
]
SOURCE_PATTERNS = [
    ("bampfa", "bampfa|berkeley art museum|pacific film archive", "BAMPFA"),
    ("calbears", "cal bears|cal athletics|calbears", "Cal Bears"),
    ("cal_performances", "cal performances", "Cal Performances"),
    ("callink", "callink|cal link", "CalLink"),
    ("haas", "haas|berkeley haas|business school", "Berkeley Haas"),
    ("berkeley_law", "berkeley law|law school|bclt", "Berkeley Law"),
    ("simons", "simons|simons institute", "Simons Institute"),
    ("livewhale", "livewhale|uc berkeley events", "UC Berkeley Events"),
]
AREA_PATTERNS = [
    ("northside", "northside|north side|northgate|euclid|hearst|north campus"),
    ("southside", "southside|south side|telegraph|south campus"),
    ("downtown", "downtown berkeley|shattuck|bart"),
]

#: Organisers that decide a category, first match wins, and weights of the evidence. Fixed values.
ORGANIZER_MAP = [
    ("eecs|electrical engineering|computer science|simons institute|data science|statistics|bioengineering|computational|informatics", "Science & Tech"),
    ("mathematics|math|physics|chemistry|biochemistry|molecular biology|neuroscience|astronomy|astrophysics|materials science|chemical engineering|civil engineering|mechanical engineering|nuclear engineering|industrial engineering", "Science & Tech"),
    ("law school|berkeley law|school of law|jurisprudence", "Academic"),
    ("haas|school of business|business school|mba program", "Entrepreneurship"),
    ("bampfa|cal performances|department of music|music department|art (?:history|practice)|theater|drama|dance|film", "Arts"),
    ("athletics|cal bears|intercollegiate sports|recreational sports|intramural", "Sports"),
    ("e-?hub|skydeck|lester center|entrepreneurship", "Entrepreneurship"),
    ("public health|epidemiology|social welfare|education|public policy|goldman school", "Academic"),
    ("serc|asuc|student (?:environmental|life|affairs|union|government|services|resource|advocate)|residential life|public service center|cal corps|basic needs|recreational? sports center|student learning center", "Student Life"),
]
ORGANIZER_MAP_WEIGHT, SOURCE_TAG_WEIGHT = 100, 40
KEYWORD_WEIGHTS = {"title": 10, "organizer": 8, "description": 3}

#: Keywords of categories; each counts by itself. Fixed values.
KEYWORDS = {
    "Science & Tech": [
        "ai", "machine learning", "deep learning", "data science", "computer science", "engineering", "robotics", "biotech", "genomics", "physics", "chemistry", "biology", "stem",
        "hackathon", "eecs", "computing", "nanotechnology", "neuroscience", "quantum", "semiconductor", "algorithm", "software", "hardware", "cybersecurity", "bioinformatics",
        "solid state", "photonics", "materials", "nanosystem", "convergent",
    ],
    "Academic": [
        "seminar", "colloquium", "lecture", "symposium", "panel", "guest speaker", "dissertation", "defense", "research", "department", "institute", "center", "program", "advising",
        "lab", "laboratory", "office hours", "conference", "workshop", "talk", "forum", "roundtable", "thesis",
    ],
    "Arts": [
        "concert", "recital", "performance", "exhibit", "exhibition", "gallery", "film", "screening", "theatre", "theater", "dance", "opera", "museum", "bampfa", "cal performances",
        "poetry", "art show", "installation", "documentary", "composer", "choreography",
    ],
    "Sports": [
        "basketball", "football", "baseball", "softball", "soccer", "volleyball", "swim meet", "swim team", "track and field", "track meet", "track team", "tennis", "gymnastics",
        "water polo", "rugby", "lacrosse", "game vs", "cal bears", "intramural", "rec sports", "rowing", "crew team", "wrestling", "golf", "cross country", "field hockey",
    ],
    "Entrepreneurship": [
        "startup", "entrepreneur", "founder", "venture", "pitch", "demo day", "skydeck", "e-hub", "product management", "innovation", "investment", "vc", "accelerator", "incubator",
        "angel investor", "seed funding", "go-to-market", "product launch", "market fit",
    ],
    "Student Life": [
        "club", "social", "mixer", "orientation", "career fair", "networking", "student org", "grad student", "undergrad", "reception", "meetup", "tabling", "info session", "open house",
        "coffee chat", "retreat", "celebration", "commencement", "graduation", "wellness", "welcome week", "student association", "gsa", "asa", "dsp", "recycling", "reuse", "zero waste",
        "donation drive", "food pantry", "basic needs", "mutual aid", "move-out",
    ],
}

#: A source's own labels. Fixed values.
SOURCE_TAGS = {
    "academic": "Academic", "academics": "Academic", "arts": "Arts", "art": "Arts", "sports": "Sports", "sport": "Sports", "athletics": "Sports",
    "science & tech": "Science & Tech", "science and tech": "Science & Tech", "science": "Science & Tech", "tech": "Science & Tech", "technology": "Science & Tech",
    "entrepreneurship": "Entrepreneurship", "entrepreneur": "Entrepreneurship", "business": "Entrepreneurship", "student life": "Student Life", "student": "Student Life",
}

MODALITIES = ["in_person", "virtual", "hybrid", "unknown"]

#: Sources in registry order: name, label, priority, expected least count, healthy least count, marked degraded, may be restored, critical. Fixed values.
SOURCES = [
    ("livewhale", "UC Berkeley Events", 4, 100, 100, True, True, True),
    ("cal_performances", "Cal Performances", 3, 10, 1, True, True, False),
    ("bampfa", "BAMPFA", 3, 20, 1, True, True, False),
    ("calbears", "Cal Bears", 3, 15, 1, True, True, False),
    ("callink", "CalLink", 3, 5, 1, True, True, False),
    ("haas", "Berkeley Haas", 3, 5, 1, True, True, False),
    ("berkeley_law", "Berkeley Law", 3, 3, 1, True, True, False),
    ("simons", "Simons Institute", 3, 10, 1, True, True, False),
    ("luma", "Luma", 3, 1, 1, False, True, False),
    ("begin", "Berkeley BEGIN", 3, 1, 1, False, True, False),
]
MAX_FALLBACK_HOURS, STALE_STATUS_HOURS, STALE_DATA_HOURS, SOURCE_CAP = 48.0, 36.0, 12.0, 5000

#: What is cut off ids to group the days of an event, by source; applied in order. Fixed values.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
ID_RULES = {
    "livewhale": [r"^\d{8}T\d{6}Z-"],
    "bampfa": [r"::\d{4}-\d{2}-\d{2}$", rf"(?i)-({MONTHS})-\d{{4}}$"],
    "simons": [r"::\d{4}-\d{2}-\d{2}$"],
}
CANCELLED = "canceled|cancelled|postponed|rescheduled"

#: Themes and groups of category names of student organisations. Fixed values.
THEMES = {
    "Arts": "Arts", "Athletics": "Sports", "CommunityService": "Student Life", "Cultural": "Student Life", "Fundraising": "Student Life", "GroupBusiness": "Student Life",
    "Social": "Student Life", "Spirituality": "Student Life", "ThoughtfulLearning": "Academic", "Unknown": "Student Life",
}
THEME_GROUPS = [
    ("academic|education|lecture|seminar|panel|talk|workshop|research|learning", "Academic"),
    ("art|music|film|performance|gallery|theater|dance|creative", "Arts"),
    ("sport|athletic|fitness|recreation|intramural", "Sports"),
    ("tech|computer|engineer|science|data|ai|stem|hack", "Science & Tech"),
    ("entrepreneur|startup|innovation|venture|business|pitch", "Entrepreneurship"),
]
GENERIC_PATHS = ("live", "event", "events")
DEFAULT_ORGANIZER, DEFAULT_LOCATION = "UC Berkeley", "Berkeley, CA"

#: Parts of a location that mark a home game. Fixed values.
HOME_VENUES = [
    "berkeley", "uc berkeley", "cal ", "memorial stadium", "haas pavilion", "edwards stadium", "evans diamond", "hearst", "recreational sports facility", "rsf", "zellerbach", "wheeler",
    "dwinelle", "soda hall", "cory hall", "doe library", "moffitt", "bancroft", "sproul", "mlk student union", "california memorial", "greek theatre", "hearst greek",
]

#: Organising units by the first part of an event's address. Fixed values.
UNITS = {
    "ac": "Arts + Culture at Berkeley", "africam": "African American Studies Department", "apasd": "Asian Pacific American Student Development", "are": "Agricultural & Resource Economics",
    "arf": "Archaeological Research Facility", "art": "Department of Art Practice", "sports": "Cal Athletics", "bot": "UC Botanical Garden", "bph": "Berkeley Public Health", "brc": "Berkeley Retirement Center",
    "bcsr": "Berkeley Center for the Study of Religion", "bs": "Buddhist Studies", "bsac": "Berkeley Sensor & Actuator Center", "ihouse": "International House", "calperfs": "Cal Performances",
    "calparents": "Cal Parents", "ced": "College of Environmental Design", "cee": "Civil & Environmental Engineering", "serc": "Student Environmental Resource Center", "chem": "Department of Chemistry",
    "cjs": "Center for Japanese Studies", "cks": "Center for Korean Studies", "clacs": "Center for Latin American and Caribbean Studies", "coe": "College of Engineering", "crb": "Center for Responsible Business",
    "crg": "Center for Race and Gender", "csas": "Center for South Asia Studies", "cseas": "Center for Southeast Asia Studies", "cshe": "Center for Studies in Higher Education",
    "csls": "Center for the Study of Law and Society", "educ": "Berkeley School of Education", "cdss": "College of Computing, Data Science, and Society", "econ": "Department of Economics",
    "extension": "UC Berkeley Extension", "geneq": "Gender Equity Resource Center", "geog": "Geography Department", "hdi": "Helen Diller Institute", "hr": "Human Resources", "hrc": "Human Rights Center",
    "ib": "Integrative Biology", "ieas": "Institute of East Asian Studies", "ies": "Institute of European Studies", "igs": "Institute of Governmental Studies", "ihd": "Institute of Human Development",
    "ischool": "School of Information", "issi": "Institute for the Study of Societal Issues", "its": "Institute of Transportation Studies", "jsp": "Jurisprudence and Social Policy Program", "law": "Berkeley Law",
    "lhs": "Lawrence Hall of Science", "ling": "Department of Linguistics", "mse": "Materials Science & Engineering", "pmb": "Plant & Microbial Biology", "publichealth": "School of Public Health",
    "gspp": "Goldman School of Public Policy", "haas": "Berkeley Haas", "bampfa": "BAMPFA", "bio": "Berkeley International Office", "botanicalgarden": "UC Botanical Garden",
    "bids": "Berkeley Institute for Data Science", "citris": "CITRIS", "cltc": "Center for Long-Term Cybersecurity", "simons": "Simons Institute", "scet": "Sutardja Center for Entrepreneurship & Technology",
    "ssm": "Social Science Matrix", "sp": "Spanish and Portuguese", "tdps": "Theater, Dance, and Performance Studies", "ttp": "Technology Transfer Program",
    "udar": "University Development and Alumni Relations", "uhs": "University Health Services", "blumcenter": "Blum Center", "ssl": "Space Sciences Laboratory", "rdi": "Berkeley RDI",
    "cnr": "College of Natural Resources", "graddiv": "Graduate Division", "library": "UC Berkeley Library", "mcb": "Molecular & Cell Biology", "physics": "Department of Physics",
    "math": "Department of Mathematics", "eecs": "EECS", "ce": "Civil & Environmental Engineering", "me": "Mechanical Engineering", "bioe": "Bioengineering",
    "magnes": "Magnes Collection of Jewish Art & Life", "music": "Department of Music",
}

#: Calendars: id, slug, organizer, unit, address, category. Fixed values.
CALENDARS = [
    ("cal-4TEeXLXVUtUqg91", "berkeleygatewayaccelerator", "Berkeley Gateway Accelerator", "Berkeley Gateway Accelerator", "Berkeley, CA", "Entrepreneurship"),
    ("cal-innEhgXVF8DutA2", "venture-accelerator", "Venture Accelerator", "Berkeley Venture Accelerator", "Berkeley, CA", "Entrepreneurship"),
    ("cal-7lfE7NPvJ79Cogr", "club-ai", "Club AI at Berkeley", "Club AI", "UC Berkeley, Berkeley, CA", "Science & Tech"),
    ("cal-NGX3EtNE8VjfQVv", "rdi_uc_berkeley", "Berkeley RDI", "Center for Responsible Decentralized Intelligence", "UC Berkeley, Berkeley, CA", "Science & Tech"),
    ("cal-QzSyFbecenFng8a", "berkeley-skydeck", "Berkeley SkyDeck", "Berkeley SkyDeck Accelerator", "2054 University Ave, Berkeley, CA", "Entrepreneurship"),
    ("cal-bHk5GbDeJ592eul", "babreserve", "Berkeley Blockchain Ecosystem", "Berkeley Blockchain", "UC Berkeley, Berkeley, CA", "Science & Tech"),
    ("cal-zpmXtN6vl2q126O", "notionatberkeley", "Notion @ UC Berkeley", "Notion Campus Chapter", "UC Berkeley, Berkeley, CA", "Student Life"),
    ("cal-0zC7mzBhjn1qZxF", "blueprintucberkeley", "Blueprint @ Berkeley", "Blueprint", "UC Berkeley, Berkeley, CA", "Student Life"),
    ("cal-hBMWrE0GDEt47fE", "berkeleymdes", "Berkeley Master of Design", "UC Berkeley College of Environmental Design", "Wurster Hall, UC Berkeley, Berkeley, CA", "Arts"),
    ("cal-5PR1bGQ6VjXuIIU", "berchainev", "BerChain", "BerChain Blockchain Community", "Berkeley, CA", "Science & Tech"),
    ("cal-iqggsuizvbXSxoO", "deeptech", "Deep Tech Innovation Lab", "Berkeley Deep Tech Innovation Lab", "UC Berkeley, Berkeley, CA", "Science & Tech"),
    ("cal-ECgZMptWPGOsxtE", "sbc", "Science of Blockchain Conference", "Stanford Center for Blockchain Research / Berkeley", "UC Berkeley, Berkeley, CA", "Science & Tech"),
]

#: Hosts of paged events: source, organizer, unit, address, category. Fixed values.
HOSTS = [
    ("haas", "Berkeley Haas", "Berkeley Haas School of Business", "2220 Piedmont Ave, Berkeley, CA 94720", "Entrepreneurship"),
    ("berkeley_law", "Berkeley Law", "UC Berkeley School of Law", "215 Law Building, Berkeley, CA 94720", "Academic"),
    ("begin", "Berkeley Gateway to Innovation", "BEGIN", "UC Berkeley, Berkeley, CA 94720", "Entrepreneurship"),
]

#: Kinds of talks that are for everyone, and the categories of talks. Fixed values.
PUBLIC_TALKS = "theoretically speaking|public lecture|karp"
TALK_CATEGORIES, PUBLIC_TALK_CATEGORIES = ["Science & Tech"], ["Science & Tech", "Academic"]
