"""A hand-kept set of lines with loosely written personal data, and of lines without any. No line was made by the training rule, and none was
changed after the operator was first measured on it. Each entry: (line, kind, the text that is personal data), or (line,)."""

FOUND = [
    ("Please drop a note to maria.lopez at gmail dot com before Friday.", "email", "maria.lopez at gmail dot com"),
    ("E-mail: tom_w (at) posteo (dot) de", "email", "tom_w (at) posteo (dot) de"),
    ("You can reach her under anna[at]uni-graz[dot]at anytime", "email", "anna[at]uni-graz[dot]at"),
    ("Mi correo es juan.perez arroba correo punto es, gracias", "email", "juan.perez arroba correo punto es"),
    ("contact: support {at} widgets {dot} io", "email", "support {at} widgets {dot} io"),
    ("Schreib mir an k.meier(at)web.de", "email", "k.meier(at)web.de"),
    ("mon courriel: luc.dupont arobase orange point fr", "email", "luc.dupont arobase orange point fr"),
    ("write to press @ cityhall.org for the minutes", "email", "press @ cityhall.org"),
    ("Mail me at bob99 [at] proton.com please", "email", "bob99 [at] proton.com"),
    ("our address is info(at)garden-club.co.uk", "email", "info(at)garden-club.co.uk"),
    ("questions? email sales AT bikes DOT com", "email", "sales AT bikes DOT com"),
    ("Kontakt: vorstand (at) sv-linden.de", "email", "vorstand (at) sv-linden.de"),
    ("mail j.smith42 at example dot org", "email", "j.smith42 at example dot org"),
    ("envoyez à claire(a)ecole.fr votre réponse", "email", "claire(a)ecole.fr"),
    ("Send it to editor [at] thepaper [dot] net today", "email", "editor [at] thepaper [dot] net"),
    ("The box answered from 192[.]168[.]0[.]14 twice", "ip", "192[.]168[.]0[.]14"),
    ("blocked host 8(.)8(.)4(.)4 at noon", "ip", "8(.)8(.)4(.)4"),
    ("ipv6 2001:0db8:85a3:0000:0000:8a2e:0370:7334 was seen", "ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
    ("ping fe80::1ff:fe23:4567:890a first", "ip", "fe80::1ff:fe23:4567:890a"),
    ("login from 10 . 20 . 30 . 40 refused", "ip", "10 . 20 . 30 . 40"),
    ("El servidor 172[.]16[.]254[.]1 no responde", "ip", "172[.]16[.]254[.]1"),
    ("C2 at 45[.]33.32.156 confirmed", "ip", "45[.]33.32.156"),
    ("the gateway is 10 dot 0 dot 0 dot 138", "ip", "10 dot 0 dot 0 dot 138"),
    ("resolver 2606:4700::6810:84e5 timed out", "ip", "2606:4700::6810:84e5"),
    ("traffic from 203{.}0{.}113{.}9 dropped", "ip", "203{.}0{.}113{.}9"),
    ("Rechner 192[.]0[.]2[.]235 neu starten", "ip", "192[.]0[.]2[.]235"),
    ("client 2001:db8::ff00:42:8329 reconnected", "ip", "2001:db8::ff00:42:8329"),
    ("my Visa is 4111.1111.1111.1111 exp 09/27", "card", "4111.1111.1111.1111"),
    ("kreditkarte: 3782.822463.10005", "card", "3782.822463.10005"),
    ("Mastercard 5555/5555/5555/4444 on file", "card", "5555/5555/5555/4444"),
    ("amex 3714_496353_98431", "card", "3714_496353_98431"),
    ("tarjeta 4012.8888.8888.1881 caducada", "card", "4012.8888.8888.1881"),
    ("charged to 6011  1111  1111  1117 yesterday", "card", "6011  1111  1111  1117"),
    ("carte bancaire 5105.1051.0510.5100 volée", "card", "5105.1051.0510.5100"),
    ("He read out 4242 / 4242 / 4242 / 4242 over the line", "card", "4242 / 4242 / 4242 / 4242"),
    ("card no. 4000 - 0566 - 5566 - 5556", "card", "4000 - 0566 - 5566 - 5556"),
    ("Karte 2223_0031_2200_3222 gesperrt", "card", "2223_0031_2200_3222"),
    ("pay with 5200.8282.8282.8210 instead", "card", "5200.8282.8282.8210"),
    ("Telefon 0171-2345678", "phone", "0171-2345678"),
    ("phone 1-800-555-0199", "phone", "1-800-555-0199"),
    ("llamame al 612 345 678", "phone", "612 345 678"),
    ("appelez le 01 23 45 67 89", "phone", "01 23 45 67 89"),
    ("Give us a ring on (415) 555-2671 after six", "phone", "(415) 555-2671"),
    ("Office: tel. 030/1234567", "phone", "030/1234567"),
    ("fax 0049 89 4567 1234", "phone", "0049 89 4567 1234"),
    ("Ruf mich unter 0151 23456789 an", "phone", "0151 23456789"),
    ("text 555.867.5309 for details", "phone", "555.867.5309"),
    ("Mobile: 07700 900123", "phone", "07700 900123"),
    ("mi móvil es 655-12-34-56", "phone", "655-12-34-56"),
    ("Tél. : 06.12.34.56.78", "phone", "06.12.34.56.78"),
    ("call the desk at 212-555-0142", "phone", "212-555-0142"),
    ("Handy 01604567890", "phone", "01604567890"),
    ("WhatsApp: 933 21 43 65", "phone", "933 21 43 65"),
    ("Our hotline (0800) 123456 is free", "phone", "(0800) 123456"),
    ("Dial (020) 7946 0958 for the clinic", "phone", "(020) 7946 0958"),
    ("numéro 04-91-00-11-22 en journée", "phone", "04-91-00-11-22"),
    ("reach Dana by phone, 646 555 0117", "phone", "646 555 0117"),
    ("Kundendienst: +49 (0)30/901820", "phone", "+49 (0)30/901820"),
]
CLEAN = [
    ("Version 10.4.2 (build 20240117) shipped on 2024-01-17 10.30",), ("The match ended 3-2 after 120 minutes, the 2010-2014 record stands.",), ("Order 4500012345678 was delivered to dock 7.",), ("ISBN 978-3-16-148410-0 is out of print",),
    ("Revenue rose from 1,234,567.00 to 2 345 678 euros",), ("We arrived at noon.Then it rained.",), ("look at that dot com bubble again",), ("She works at home and he works at sea.",), ("invoice no. 2023-000451-77 is overdue",), ("Bestellnummer 99-4421-0077 bitte angeben",),
    ("the years 1914 1918 1939 1945 are underlined",), ("std::vector is faster than a::b::c here",), ("coordinates 52.5200 13.4050 on the map",), ("Chapter 3 . 4 . 512 . 7 covers sorting",), ("at 12:30:45 the sensor read 17.5",), ("serial 4021.9931.2210.7745 engraved below",),
    ("SKU 0044-1187-2230 has three colours",), ("Konto 12 345 678 wurde geschlossen",), ("the ratio was 16/9 or 4/3 at best",), ("MAC 00:1a:2b:3c:4d:5e joined the network",), ("pedido 612-2231-09 enviado ayer",), ("He was born on 01.02.1965 and died on 30.11.2011.",),
    ("meet me at the corner, dot your i's",), ("page 100 - 115 and 230 - 247",), ("Total: 49 99 12 00 units in four boxes",), ("the pH was 7.4 7.5 7.6 7.7 in turn",), ("Release 2024.10.03-114500 fixes it",), ("from 10 000 000 to 12 000 000 people",), ("batch 20240117-093015 passed",),
    ("seats 12 13 14 15 16 17 are taken",), ("tracking 1234 5678 9012 3456 7890 12 in transit",), ("article 1234567890128 in stock",), ("timestamp 1700000000000 in the log",), ("§ 312 (4) 2 says so",), ("population 3 645 000 (2019)",), ("He stayed at hotel point four on the list.",),
    ("une heure à midi point final",), ("room 204-311 and 205-118",), ("The ticket 55512 34567 was closed",), ("9 3 1 4 4 1 2 8 7 6 were drawn",), ("an odd sum: 0.1 + 0.2 . 30 . 4000",), ("bus lines 100, 200 and M41",), ("Grundstück 12/345-6 und 12/346-1",), ("we bought it at ebay.The box came late",),
    ("Date: 17/01/2024 08:15",), ("vote 51-49 (2020) 48-52 (2024)",), ("Section 4.1.2.999 is void",), ("model AT dot matrix printer",), ("part number 555-1234-9",), ("a price of 19.99 . 24.99 . 29.99 . 34.99",),
]
