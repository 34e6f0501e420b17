"""Registry of the public feeds (FIXED VALUES, 43 rows).

Columns: id, name, kind, url, parser, poll interval in seconds, forced category
or None, opt_in.
"""


SOURCES = [
    ("gdacs", "GDACS alerts", "Alert", "https://www.gdacs.org/xml/rss.xml", "gdacs", 300, None, False),
    ("usgs", "USGS earthquakes", "Alert", "https://earthquake.usgs.gov/earthquakes/feed/v1.0/summary/4.5_day.geojson", "usgs", 180, "Earthquake", False),
    ("eonet", "NASA EONET", "Alert", "https://eonet.gsfc.nasa.gov/api/v3/events?status=open&limit=60", "eonet", 900, "NaturalDisaster", False),
    ("reliefweb", "ReliefWeb disasters", "Humanitarian", "https://reliefweb.int/disasters/rss.xml", "feed", 900, None, False),
    ("un-news", "UN News", "Humanitarian", "https://news.un.org/feed/subscribe/en/news/all/rss.xml", "feed", 600, None, False),
    ("bbc", "BBC World", "News", "https://feeds.bbci.co.uk/news/world/rss.xml", "feed", 240, None, False),
    ("aljazeera", "Al Jazeera", "News", "https://www.aljazeera.com/xml/rss/all.xml", "feed", 240, None, False),
    ("guardian", "Guardian World", "News", "https://www.theguardian.com/world/rss", "feed", 240, None, False),
    ("france24", "France 24", "News", "https://www.france24.com/en/rss", "feed", 300, None, False),
    ("dw", "Deutsche Welle", "News", "https://rss.dw.com/rdf/rss-en-world", "feed", 300, None, False),
    ("npr", "NPR World", "News", "https://feeds.npr.org/1004/rss.xml", "feed", 420, None, False),
    ("cbs", "CBS World", "News", "https://www.cbsnews.com/latest/rss/world", "feed", 300, None, False),
    ("wsj", "WSJ World", "News", "https://feeds.a.dj.com/rss/RSSWorldNews.xml", "feed", 420, None, False),
    ("scmp", "South China Morning Post", "News", "https://www.scmp.com/rss/91/feed", "feed", 420, None, False),
    ("toi", "Times of Israel", "News", "https://www.timesofisrael.com/feed/", "feed", 300, None, False),
    ("elpais", "El País (English)", "News", "https://feeds.elpais.com/mrss-s/pages/ep/site/english.elpais.com/portada", "feed", 420, None, False),
    ("fox", "Fox World", "News", "https://moxie.foxnews.com/google-publisher/world.xml", "feed", 420, None, False),
    ("yt-bbc", "YouTube · BBC News", "Video", "https://www.youtube.com/feeds/videos.xml?channel_id=UC16niRr50-MSBwiO3YDb3RA", "feed", 600, None, False),
    ("yt-aljazeera", "YouTube · Al Jazeera", "Video", "https://www.youtube.com/feeds/videos.xml?channel_id=UCNye-wNBqNL5ZzHSJj3l8Bg", "feed", 600, None, False),
    ("yt-dw", "YouTube · DW News", "Video", "https://www.youtube.com/feeds/videos.xml?channel_id=UCknLrEdhRCp1aegoMqRaCZg", "feed", 600, None, False),
    ("yt-france24", "YouTube · France 24", "Video", "https://www.youtube.com/feeds/videos.xml?channel_id=UCQfwfsi5VrQ8yKZ-UWmAEFg", "feed", 600, None, False),
    ("yt-reuters", "YouTube · Reuters", "Video", "https://www.youtube.com/feeds/videos.xml?channel_id=UChqUTb7kYRX8-EiaN3XFrSQ", "feed", 600, None, False),
    ("yt-sky", "YouTube · Sky News", "Video", "https://www.youtube.com/feeds/videos.xml?channel_id=UCoMdktPbSTixAyNGwb-UYkQ", "feed", 600, None, False),
    ("yt-guardian", "YouTube · Guardian", "Video", "https://www.youtube.com/feeds/videos.xml?channel_id=UCIRYBXDze5krPDzAEOxFGVA", "feed", 600, None, False),
    ("yt-ap", "YouTube · AP", "Video", "https://www.youtube.com/feeds/videos.xml?channel_id=UC52X5wxOL_s5yw0dQk7NtgA", "feed", 600, None, False),
    ("yt-cna", "YouTube · CNA", "Video", "https://www.youtube.com/feeds/videos.xml?channel_id=UC83jt4dlz1Gjl58fzQrrKZg", "feed", 900, None, False),
    ("yt-nbc", "YouTube · NBC News", "Video", "https://www.youtube.com/feeds/videos.xml?channel_id=UCeY0bbntWzzVIaj2z3QigXg", "feed", 900, None, False),
    ("yt-wion", "YouTube · WION", "Video", "https://www.youtube.com/feeds/videos.xml?channel_id=UC_gUM8rL-Lrg6O3adPW9K1g", "feed", 900, None, False),
    ("bsky-reuters", "Bluesky · Reuters", "Social", "https://public.api.bsky.app/xrpc/app.bsky.feed.getAuthorFeed?actor=reuters.com&limit=40&filter=posts_no_replies", "bluesky", 120, None, False),
    ("bsky-ap", "Bluesky · AP", "Social", "https://public.api.bsky.app/xrpc/app.bsky.feed.getAuthorFeed?actor=apnews.com&limit=40&filter=posts_no_replies", "bluesky", 120, None, False),
    ("bsky-guardian", "Bluesky · Guardian", "Social", "https://public.api.bsky.app/xrpc/app.bsky.feed.getAuthorFeed?actor=theguardian.com&limit=40&filter=posts_no_replies", "bluesky", 180, None, False),
    ("bsky-aljazeera", "Bluesky · Al Jazeera", "Social", "https://public.api.bsky.app/xrpc/app.bsky.feed.getAuthorFeed?actor=aljazeera.com&limit=40&filter=posts_no_replies", "bluesky", 180, None, False),
    ("bsky-npr", "Bluesky · NPR", "Social", "https://public.api.bsky.app/xrpc/app.bsky.feed.getAuthorFeed?actor=npr.org&limit=40&filter=posts_no_replies", "bluesky", 240, None, False),
    ("masto-breaking", "Mastodon · #breakingnews", "Social", "https://mastodon.social/api/v1/timelines/tag/breakingnews?limit=40", "mastodon", 180, None, False),
    ("masto-ukraine", "Mastodon · #ukraine", "Social", "https://mastodon.social/api/v1/timelines/tag/ukraine?limit=40", "mastodon", 240, None, False),
    ("masto-gaza", "Mastodon · #gaza", "Social", "https://mastodon.social/api/v1/timelines/tag/gaza?limit=40", "mastodon", 240, None, False),
    ("masto-conflict", "Mastodon · #conflict", "Social", "https://mastodon.social/api/v1/timelines/tag/conflict?limit=40", "mastodon", 300, None, False),
    ("reddit-worldnews", "Reddit · r/worldnews", "Social", "https://www.reddit.com/r/worldnews/new/.rss?limit=50", "feed", 600, None, True),
    ("reddit-anime-titties", "Reddit · r/anime_titties", "Social", "https://www.reddit.com/r/anime_titties/new/.rss?limit=50", "feed", 900, None, True),
    ("tg-disclosetv", "Telegram · disclosetv", "Social", "https://t.me/s/disclosetv", "telegram", 180, None, True),
    ("tg-warmonitors", "Telegram · WarMonitors", "Social", "https://t.me/s/WarMonitors", "telegram", 180, None, True),
    ("gdelt-conflict", "GDELT · conflict", "News", "https://api.gdeltproject.org/api/v2/doc/doc?query=(conflict%20OR%20strike%20OR%20offensive)&mode=artlist&format=json&maxrecords=60&timespan=2h&sort=datedesc", "gdelt", 900, None, True),
    ("gdelt-disaster", "GDELT · disaster", "News", "https://api.gdeltproject.org/api/v2/doc/doc?query=(earthquake%20OR%20flood%20OR%20wildfire%20OR%20cyclone)&mode=artlist&format=json&maxrecords=60&timespan=4h&sort=datedesc", "gdelt", 1200, None, True),
]
