"""Categories and facets of events from weighted text signals, and the rules around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import signals
from tidewell.functions.signals import Rules, Run, Signal

DECISIVE, STRONG, SOFT, WEAK = 100, 70, 40, 25
#: Order of categories where scores tie.
PRIORITY = ("music", "comedy", "theater", "film", "visual-art", "sports", "fitness", "food", "learning", "outdoors", "festival", "market", "games", "civic", "other")
#: A second category needs this score, and this share of the first one's.
SECOND_SCORE, SECOND_SHARE = 40, 0.5


# Weights, category names and their order, and words that must lead to the categories events have now.  They are only
# defaults; pass ``Rules`` of your own (places, teams, another taxonomy), of any number.
SIGNALS = (
    Signal("music", DECISIVE, ("concert{,s}", "symphony", "orchestra", "recital", "live {music,band,bands}", "open mic", "karaoke", "{album,ep,single} release", "{disco,dance} party", "{jazz,blues,club} night", "dj set")),
    Signal("music", STRONG, ("singer songwriter", "{guitar,violin,cell,pian,saxophon,bass}ist", "drummer", "{two,three,four,five,six} piece band", "debut {album,record,single}", "touring {band,artist,musician}")),
    Signal("music", STRONG, ("dj",), scope="title"),
    Signal("music", SOFT, ("jazz", "blues", "bluegrass", "reggae", "hip hop", "americana")),
    Signal("music", SOFT, ("band", "performer", "musician", "vocalist", "jam session"), scope="title"),
    Signal("music", WEAK, ("music",), scope="title"),
    Signal("music", STRONG, ("tour",), scope="title", unless=("{walking,guided,garden,home,food,brewery,trolley,museum,haunted,farm,history,public,private,wine} tour{,s}",)),
    Signal("comedy", 110, ("comedy {night,show,jam,club}",), outside="comedy"),
    Signal("comedy", DECISIVE, ("stand up comedy", "{stand up ,}comedian{,s}", "improv", "sketch comedy", "drag {show,brunch,king,queen,bingo}"), outside="comedy"),
    Signal("comedy", 110, ("open mic",), outside="comedy", needs=("comedy", "comedian{,s}")),
    Signal("theater", DECISIVE, ("theat{er,re}", "playwright", "broadway", "stage {play,production}", "opera", "ballet", "musical {production,comedy}")),
    Signal("theater", STRONG, ("murder mystery", "drama {club,class}")),
    Signal("film", DECISIVE, ("screening", "cinema", "{movie,film} night", "documentary", "{short,feature,silent} film{,s}", "film festival")),
    Signal("film", STRONG, ("film{,s}",)),
    Signal("visual-art", DECISIVE, ("gallery", "exhibition", "sculpture", "mural", "art {show,walk,fair}", "installation", "artist {talk,reception}")),
    Signal("visual-art", STRONG, ("pottery", "ceramics", "knitting", "crochet", "quilt*", "{water color,watercolor}", "calligraphy", "weaving", "embroider*")),
    Signal("sports", DECISIVE, ("{hockey,baseball,basketball,league,home} game", "playoff{,s}", "championship", "stadium")),
    Signal("sports", STRONG, ("soccer", "football", "volleyball", "wrestling", "pickleball", "tennis", "softball", "lacrosse")),
    Signal("sports", STRONG, ("vs",), scope="title", followed=True),
    Signal("fitness", DECISIVE, ("{yoga,pilates,crossfit,hiit}", "#k", "# k", "{fun,trail,color} run", "kayaking", "{spin,cycle,barre} class")),
    Signal("fitness", DECISIVE, ("marathon", "half marathon"), before=("movie", "film", "reading", "book", "gaming", "game", "series", "music", "study", "dance")),
    Signal("food", DECISIVE, ("{wine,beer,whiskey,cheese,coffee,chocolate} tasting", "cooking class", "food truck{,s}", "brunch", "brewery", "winery", "tasting menu", "{wine,chefs} dinner")),
    Signal("learning", DECISIVE, ("certification", "professional development", "# day workshop", "coding bootcamp", "continuing education")),
    Signal("learning", STRONG, ("seminar", "lecture{, series}", "symposium", "webinar", "conference", "{info,information} session", "{job,tax,legal} {clinic,fair,club}", "homework help", "computer {class,basics,skills}")),
    Signal("learning", SOFT, ("workshop", "class", "course", "lesson", "{book,reading} {club,group,discussion}")),
    Signal("learning", SOFT, ("learn",), after=("more", "why", "all", "about", "everything", "here", "now", "first", "today", "tomorrow"), followed=True),
    Signal("outdoors", STRONG, ("{nature,bike,hiking} trail", "nature {walk,center}", "wildlife", "hik{e,ing}", "bird{ing,watching, walk}", "fishing", "camping", "kayak")),
    Signal("outdoors", SOFT, ("park", "zoo", "garden", "trail")),
    Signal("festival", DECISIVE, ("festival", "fireworks", "carnival", "parade", "block party")),
    Signal("festival", STRONG, ("fair", "fest", "{community,field,fun} day")),
    Signal("market", DECISIVE, ("{farmer s,farmers,makers,night,flea,holiday,artisan,craft} market", "craft {show,fair}", "plant sale", "{clothing,book,toy,seed,record} swap{,s}", "swap {meet,shop,day}")),
    Signal("games", DECISIVE, ("{trivia,game,games} night", "board game{,s}", "tabletop", "mahjong", "{e sports,esports}", "pub quiz", "euchre")),
    Signal("games", STRONG, ("trivia", "chess", "bingo", "puzzle{,s}", "pinball", "arcade", "card game{,s}")),
    Signal("civic", STRONG, ("town hall", "city council", "public hearing", "{ward,community,neighborhood,board,annual} meeting")),
)
COMIC = ("stand up comedy", "comedy{, show}", "comedian{,s}", "improv")
CHILDREN = ("bab{y,ies}", "infant{,s}", "newborn{,s}", "toddler{,s}", "child{,ren}", "kid{,s}", "daughter{,s}", "son{,s}", "girl{,s}", "boy{,s}", "student{,s}", "minor{,s}")
WHOSE = ("a", "an", "the", "her", "his", "their", "my", "our", "your", "own", "young", "little", "newborn", "infant", "unborn", "local", "area", "#", "two", "three", "four", "five", "six", "year", "month", "old")
#: Nouns that make fund-raising before them a gathering, and words that say nothing of it.
GATHERINGS = "auction ball breakfast brunch concert dance dinner drive event gala lunch luncheon night party picnic raffle run sale show supper tournament walk".split()
SMALL_WORDS = "and at by for from in is of on or that the this to with will".split()
#: (group, run): comedy that is not the event, words for families that speak of somebody else, fund-raising in general.
ASIDES = (
    ("comedy", Run(("plus", "also", "as well as", "along with"), COMIC)),
    ("comedy", Run(("comedy", "comedian{,s}"), ("{will,to} {kick,open,warm,start,get}",), gap=40, to_end=1_000_000_000)),
    ("comedy", Run(("{lover,fan}{,s} of",), ("and {stand up ,}comedy",))),
    ("comedy", Run(("topic{,s}", "even {some,a little}", "former"), COMIC)),
    ("comedy", Run(("after {party,parties}", "main event"), ("drag {show,brunch,king,queen}",))),
    ("comedy", Run(("drag {show,brunch,king,queen}",), ("after {party,parties}", "main event"))),
    ("family", Run(("{cannot,can not,can t,do not,don t,won t,may not,no,unable to} {admit,allow,accommodate,permit,bring}",), to_end=80)),
    ("family", Run(("kids of all ages", "family {owned,recipe,name}", "boot{, }camp{,s}"))),
    ("family", Run(("{his,her,their,my,our} {two,three,four,five,six,#}",), ("children", "kids", "grandchildren"), fillers=("young", "little", "grown"))),
    ("family", Run(("support{,s,ing}", "benefit{,s,ing}", "serv{es,ing}", "sponsor{,s,ing}", "empower{s,ing}"), ("youth", "children", "families"), fillers=("the", "our", "local", "area", "disadvantaged", "at", "risk"))),
    ("family", Run(("youth {services,ministry,fund,foundation,council}",))),
    ("family", Run(("senior{,s}", "adult{,s}"), ("camp{,s}",), gap=25)),
)
RULES = Rules(
    SIGNALS,
    ASIDES,
    family=("story{, }time", "story hour", "kid{,s}", "child{ren,}", "family {friendly,day,game night}", "toddler{,s}", "preschool*", "ages # {to ,}#", "grade{,s} #", "bab{y,ies}", "all ages family"),
    family_title=("teen{,s}", "tween{,s}", "youth", "junior", "family fun", "{art,day,science,summer,music,sports} camp{,s}"),
    fundraiser=(
        Signal("fundraiser", DECISIVE, ("fundraiser", "gala", "silent auction", "benefit {concert,dinner,show,night,auction}", "charity {gala,run,walk,auction,ball}", "{donation,food,blood,coat,toy,book} drive", "volunteers needed", "proceeds {benefit,support,go to}", "raise {money,funds}", "{park,river,trail,beach,litter} {cleanup,clean up}")),
        Signal("fundraiser", DECISIVE, ("{fundraising,fund raising}",), ahead_of=tuple(w for g in GATHERINGS for w in (g, g + "s")) + tuple(SMALL_WORDS)),
    ),
    framing=("prevent{,ion,ing}", "awareness", "education{,al}", "training", "workshop", "hotline", "resources", "support group", "safety", "screening", "warning signs", "first aid"),
    topics=("suicide", "self harm", "overdose", "opioid{,s}", "addiction", "abuse", "assault", "violence", "traffick*", "bullying", "drowning", "gun", "abduct*", "kidnap*", "missing"),
    child_harm=(
        Run(("stillborn", "miscarriage", "sudden infant death", "{infant,pregnancy} loss")),
        Run(("{infant,neonatal,child,childhood} {death,deaths,mortality,homicide}",)),
        Run(("{death,loss,killing,murder,disappearance,abduction} of",), CHILDREN, fillers=WHOSE),
        Run(("murder{ed,ing,s}", "kill{ed,ing,s}", "strangl{ed,ing}", "suffocat{ed,ing}", "drown{ed,s}", "abandon{ed,s}", "abduct{ed,s}", "kidnap{ped,s}", "molest{ed,ing}", "starv{ed,ing}"), CHILDREN, fillers=WHOSE, most=5),
        Run(("{child,childhood,infant} {abuse,neglect,endangerment,exploitation,abduction}", "child traffick*")),
        Run(("{abuse,neglect,exploitation} of",), CHILDREN, fillers=WHOSE),
        Run(("{missing,murdered,slain,abducted,kidnapped} {child,children,girl,boy,teen,baby}",)),
    ),
    serious=("murder{,ed,s}", "homicide", "manslaughter", "killed", "stabb{ed,ing}", "shot dead", "assault", "serial killer", "overdose", "massacre", "domestic violence"),
    cues=("arrested", "convict{ed,ion}", "on trial", "sentenced to", "cold case", "unsolved", "true {crime,story}", "real life", "survivor", "autopsy", "prosecut*"),
    fiction=("murder myster{y,ies}", "mystery {dinner,party,night,game}", "whodunit", "escape room{,s}", "novel", "play by", "thriller film"),
)


def scores(title: Column, description: Column, rules: Rules = RULES) -> Column:
    """Array of struct<category, score> of the categories with a score; each signal counts once."""
    return signals.read(title, description, rules)["scores"]


def ranked(scored: Column, priority: tuple[str, ...] = PRIORITY) -> Column:
    """One or two categories: the highest score, and the next if it is high enough; else other."""
    order = F.array(*map(F.lit, priority))
    keyed = F.array_sort(F.transform(scored, lambda s: F.struct((-s["score"]).alias("lost"), F.array_position(order, s["category"]).alias("at"), s["category"].alias("category"))))
    first, second = F.get(keyed, F.lit(0)), F.get(keyed, F.lit(1))
    both = (-second["lost"] >= SECOND_SCORE) & (-second["lost"] >= SECOND_SHARE * -first["lost"])
    return F.when(F.size(keyed) == 0, F.array(F.lit("other"))).when(F.coalesce(both, F.lit(False)), F.array(first["category"], second["category"])).otherwise(F.array(first["category"]))


def facets(title: Column, description: Column, rules: Rules = RULES) -> Column:
    """struct<family, fundraiser, veto>: words count outside the phrases that do not tell of the event; a harm rule vetoes family."""
    found = signals.read(title, description, rules)
    return F.struct(found["family"].alias("family"), found["fundraiser"].alias("fundraiser"), found["rule"].alias("veto"))


def resolve(native: Column, hint: Column, inferred: Column, default: Column, slugs: tuple[str, ...] = PRIORITY) -> Column:
    """At most two categories: the source's own, else a hint before the inferred ones; other only alone; a default in place of it."""
    known = F.array(*map(F.lit, slugs))
    hinted = F.when(F.array_contains(known, hint), F.array_distinct(F.concat(F.array(hint), inferred))).otherwise(inferred)
    some = F.array_intersect(F.array_distinct(F.when(F.size(native) > 0, native).otherwise(hinted)), known)
    bare = F.when(F.size(some) > 1, F.array_remove(some, "other")).otherwise(some)
    two = F.slice(bare, 1, 2)
    out = F.when(F.size(two) == 0, F.array(F.lit("other"))).otherwise(two)
    rescue = (out == F.array(F.lit("other"))) & F.coalesce(F.array_contains(known, default) & (default != "other"), F.lit(False))
    return F.when(rescue, F.array(default)).otherwise(out)


def resolve_family(source_flag: Column, inferred: Column, vetoed: Column) -> Column:
    return F.coalesce(source_flag, inferred) & ~vetoed


def should_recategorise(now: Column, proposed: Column) -> Column:
    """Only from none or a bare other to something real."""
    bare = (F.coalesce(F.size(now), F.lit(0)) == 0) | (now == F.array(F.lit("other")))
    return bare & (proposed != F.array(F.lit("other")))


# Words of a town's or a congregation's calendar by which events are public or not.
GOVERNANCE = ("meeting{,s}", "commission", "committee", "council", "board", "caucus", "{work,workshop,executive} session", "agenda", "hearing", "trustee{,s}", "levy", "civil service")
CLOSURES = ("{office,offices,building,city hall} closed",)
HOLIDAYS = ("christmas {day,eve}", "veterans day", "independence day", "new year{ ,}s {day,eve}", "memorial day", "labor day", "thanksgiving{, day}", "president{ ,}s day", "martin luther king {jr . ,}day", "juneteenth", "columbus day", "good friday", "easter")
TOWN_EVENTS = ("fest{ival,}", "parade", "concert", "fireworks", "market", "movie{,s}", "music", "celebration", "ceremony", "egg hunt", "trick or treat", "santa", "tree lighting", "run", "walk", "#k", "expo", "open house")
CONGREGATIONS = ("church", "parish", "cathedral", "chapel", "congregation", "synagogue", "temple", "mosque", "masjid", "diocese", "ministr{y,ies}", "lutheran", "methodist", "baptist", "presbyterian", "episcopal", "catholic", "orthodox", "evangel*")
FAITH_PUBLIC = (
    "concert{,s}", "recital", "symphony", "orchestra", "open mic", "fest{ival,}", "fair", "bazaar", "carnival", "jubilee", "block party", "fundrais*", "benefit{,s}", "gala", "auction", "golf outing", "#k", "fun run", "car wash",
    "rummage", "{flea,farmers,farmer s,holiday,christmas} market", "{garage,yard,estate,craft,bake,book,plant} sale", "craft show", "fish fry", "{pancake,community,free} breakfast", "{spaghetti,pasta,chicken,community,free} dinner", "food truck",
    "community {meal,lunch,supper,picnic,cookout}", "free {meal,lunch}", "soup supper", "{blood,food,clothing,coat} drive", "food pantry", "community garden", "vacation bible school", "vbs", "day camp", "trunk or treat", "trick or treat", "egg hunt",
    "tree lighting", "{live ,}nativity", "pumpkin{,s}", "hayride", "petting zoo", "art {show,walk}", "gallery", "{quilt,car} show", "open house", "grand opening", "public {lecture,forum,talk}",
)


def says(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of some phrases as whole words; one native expression, for short lists."""
    words = "|".join(p.replace("*", "[^ ]*").replace(".", r"\.") for raw in phrases for p in signals.expand(raw))
    return signals.plain(text).rlike(f" (?:{words}) ")


def municipal_public(title: Column) -> Column:
    """Whether a town's entry is for the public: false for none, what is called off, governance, and closed offices; other closures
    and bare holidays count only beside words of public events."""
    name = F.trim(signals.plain(title))
    holiday = name.isin([h for raw in HOLIDAYS for h in signals.expand(raw)])
    off = says(title, ("cancel{led,ed}", "postponed")) | says(title, GOVERNANCE) | says(title, CLOSURES) | signals.plain(title).rlike(r" closed [^.]*(?:holiday|observ)")
    return (name != "") & ~off & (~(says(title, ("closed",)) | holiday) | says(title, TOWN_EVENTS))


def congregation(name: Column) -> Column:
    """Whether a name is that of a place of worship."""
    return says(name, CONGREGATIONS)


def allowlisted(title: Column, description: Column | None = None, phrases: tuple[str, ...] = FAITH_PUBLIC) -> Column:
    """Only what speaks of a gathering that is open to all; a congregation's other entries are its own."""
    return says(F.concat_ws(" ", title, *([] if description is None else [description])), phrases)
