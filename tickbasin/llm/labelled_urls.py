"""A small labelled table of well-known public addresses, from which the url filter learns.

Blocked: adult content, gambling, pill shops, file piracy, advert and tracking
servers, link spam.  Ordinary: news, learning, public bodies, health, shops,
culture, software.  Some ordinary names hold a part that looks blocked (essex,
scunthorpe, alphabets), so that the model learns more than such parts.

Most hosts have names that no table lists.  So rows are added by a rule: hosts
of invented syllables and of ordinary words are ordinary, hosts of words that
blocked sites use are blocked, and both get the same ends of names, subdomains,
endings and paths, which therefore tell nothing.
"""

from __future__ import annotations

import hashlib

#: Rows that the rule makes: of invented names, of ordinary words, and to block.
INVENTED, WORDED, BAD = 500, 300, 300

# Addresses to block.
BLOCKED = """
https://www.pornhub.com/video https://xvideos.com/ https://www.xnxx.com/search https://xhamster.com/videos/new https://www.redtube.com/ https://youporn.com/category https://spankbang.com/ https://www.brazzers.com/
https://chaturbate.com/female-cams https://livejasmin.com/en/girls https://stripchat.com/ https://www.adultfriendfinder.com/ https://cam4.com/ https://nudevista.com/ https://www.eporner.com/ https://porntube.com/hd
https://www.bet365.com/ https://www.pokerstars.com/poker/ https://www.888casino.com/slots https://www.williamhill.com/betting https://www.betfair.com/sport https://unibet.com/casino https://www.ladbrokes.com/ https://bwin.com/sports
https://www.partypoker.com/ https://casino.com/roulette https://slotomania.com/ https://www.betway.com/casino https://stake.com/casino/games https://1xbet.com/live https://www.jackpotcity.com/ https://bovada.lv/poker https://lottery.com/play
https://www.onlinecasino.de/ https://sportsbetting.ag/ https://freeslots.com/ https://betonline.ag/casino https://vegasslotsonline.com/ https://www.paddypower.com/bet https://pinnacle.com/betting
https://buyviagra.org/ https://cheap-cialis.net/order https://www.canadianpharmacy.cc/viagra https://pills24.com/cialis https://steroids-shop.net/buy https://rxpills-online.com/ https://nopriorscript.com/pills https://generic-viagra.info/
https://thepiratebay.org/top/all https://1337x.to/torrents https://www.limetorrents.lol/ https://rarbg.to/torrents.php https://kickasstorrents.to/ https://torrentz2.eu/ https://www.warez-bb.org/ https://crackstreams.com/ https://cracked-games.org/
https://fmovies.to/movie https://putlocker.is/ https://keygens.pro/crack https://serials.ws/ https://nulled.to/ https://eztv.re/torrent https://yts.mx/torrent
https://doubleclick.net/ads https://ads.google.com/adclick https://adservice.google.com/ads https://www.popads.net/ https://propellerads.com/ https://adsterra.com/ https://track.adform.net/ https://ads.yahoo.com/banner https://adnxs.com/tracker
https://outbrain.com/ads https://cdn.taboola.com/ads https://adroll.com/pixel https://ad.turn.com/server/ads https://trafficjunky.com/ads https://exoclick.com/ads https://adserver.adtech.de/ https://clickbank.net/promo https://pop.exoads.com/
https://free-followers.top/ https://win-a-prize-now.xyz/claim https://cheap-backlinks.biz/seo https://earn-money-fast.club/ https://getrichquick.top/ https://free-gift-cards.win/claim https://hot-singles-near.me/ https://payday-loans-fast.net/ https://spamlinks.biz/
"""

# Ordinary addresses.
ORDINARY = """
https://www.bbc.co.uk/news/world https://www.theguardian.com/science https://www.nytimes.com/section/books https://www.reuters.com/business https://www.lemonde.fr/culture https://www.spiegel.de/wissenschaft https://elpais.com/internacional https://apnews.com/hub/health
https://en.wikipedia.org/wiki/History https://de.wikipedia.org/wiki/Wald https://www.britannica.com/science/biology https://www.gutenberg.org/ebooks/1342 https://archive.org/details/texts https://stackoverflow.com/questions/tagged https://github.com/apache/spark https://docs.python.org/3/library
https://spark.apache.org/docs/latest https://www.postgresql.org/docs https://developer.mozilla.org/en-US/docs https://kernel.org/doc https://www.debian.org/releases https://arxiv.org/list/cs https://www.nature.com/articles https://www.science.org/news
https://www.mit.edu/research https://www.ox.ac.uk/admissions https://www.essex.ac.uk/courses https://www.sussex.ac.uk/study https://www.harvard.edu/about https://ethz.ch/en/studies https://www.sorbonne-universite.fr/ https://www.tum.de/studium
https://www.nhs.uk/conditions https://www.who.int/health-topics https://www.cdc.gov/flu https://www.mayoclinic.org/diseases https://www.gesundheit.gv.at/ https://www.cancer.org/treatment https://pubmed.ncbi.nlm.nih.gov/ https://www.webmd.com/allergies
https://www.gov.uk/browse/housing https://www.scunthorpe.co.uk/ https://www.northlincs.gov.uk/council https://www.usa.gov/benefits https://www.service-public.fr/particuliers https://www.bundestag.de/dokumente https://europa.eu/youth https://www.un.org/en/climatechange
https://www.nasa.gov/missions https://www.esa.int/Science https://www.metoffice.gov.uk/weather https://www.noaa.gov/ocean https://www.usgs.gov/volcanoes https://www.nationalgeographic.com/animals https://www.si.edu/exhibitions https://www.kew.org/gardens
https://www.louvre.fr/en/explore https://www.britishmuseum.org/collection https://www.tate.org.uk/art https://www.moma.org/calendar https://www.metmuseum.org/art https://www.rijksmuseum.nl/en https://www.royalalberthall.com/ https://www.classicfm.com/composers
https://www.amazon.com/books https://www.ikea.com/furniture https://www.etsy.com/market https://www.ebay.co.uk/deals https://www.lego.com/themes https://www.waterstones.com/category https://www.alphabets.net/letters https://www.johnlewis.com/home
https://www.allrecipes.com/recipes https://www.bbcgoodfood.com/recipes https://www.kingarthurbaking.com/bread https://www.seriouseats.com/ https://www.marmiton.org/ https://www.chefkoch.de/rezepte https://www.rhs.org.uk/plants https://www.gardenersworld.com/
https://www.fifa.com/tournaments https://www.olympics.com/en/sports https://www.wimbledon.com/ https://www.uefa.com/ https://www.cyclingnews.com/races https://www.ramblers.org.uk/walks https://www.lonelyplanet.com/europe https://www.nationalrail.co.uk/stations
https://www.sbb.ch/en/timetable https://www.heathrow.com/arrivals https://www.booking.com/hotels https://www.tripadvisor.com/museums https://www.openstreetmap.org/about https://www.weather.com/forecast https://www.khanacademy.org/math https://www.coursera.org/browse
https://www.imdb.com/title https://www.goodreads.com/book https://www.poetryfoundation.org/poems https://www.rottentomatoes.com/ https://www.bandcamp.com/discover https://www.wired.com/category/science https://www.economist.com/leaders https://www.bankofengland.co.uk/statistics
"""

# Parts of the names that the rule makes.
SYLLABLES = "ba bel bor ca cle da den dor el en fa fin ga gra ha hol in ka kel la len lo ma mer mi mo na nel no or pa per qui ra ren ro sa sel sha si ta tel th ti ton tra u va vel vi wa wel win xi ya zen zo"
GOOD_WORDS = "news school library museum garden kitchen history science weather travel music health city county college research journal book recipe nature sport football river mountain software data map art theatre bakery church hotel station family design cats bike film wood stone paper"
BAD_WORDS = "casino poker slots betting jackpot roulette porn xxx sex adult cams escort viagra cialis pills pharma torrent warez crack keygen spam backlink followers payday prize giveaway adserver popunder lotto nude"
ENDS = "win farm hub zone club best top live now shop deal online world page site land central point daily royale"
SUBDOMAINS = ". . . www. www. m. blog. news."
ENDINGS = "com com org net de fr ca co.uk info io"
PATHS = "/ /en/{n} /de/{n}.html /about /{n}/ /fr/{n} /category/{n} /2024/05/{n} /index.php /es/{n}/ /page-{n}.html /"


def made_by_rule() -> list[tuple[str, int]]:
    """Addresses with 1 for those to block, drawn by hashes, so always the same."""
    out = []
    for k in range(INVENTED + WORDED + BAD):
        digest = hashlib.sha256(f"url {k}".encode()).digest()
        draws = iter(digest)

        def one(words: str, draws=draws) -> str:
            listed = words.split()
            return listed[next(draws) % len(listed)]

        if k < INVENTED:
            name = "".join(one(SYLLABLES) for _ in range(2 + next(draws) % 3))
        else:
            name = one(GOOD_WORDS if k < INVENTED + WORDED else BAD_WORDS)
        turn = next(draws) % 5
        name = [name, f"{name}-{one(ENDS)}", f"{one(ENDS)}-{name}", f"{name}{one(ENDS)}", f"{one(SYLLABLES)}{name}"][turn]
        out.append((f"https://{one(SUBDOMAINS).lstrip('.')}{name}.{one(ENDINGS)}{one(PATHS).format(n=int.from_bytes(digest[-2:]) % 1000)}", int(k >= INVENTED + WORDED)))
    return out
