"""Hand-checked texts, written by hand and not taken from any table: a third each seeds the training, calibrates and tests."""

from __future__ import annotations

_P = [
    "The loader reads the file twice, which is why the second pass feels slow. We should keep the first result and move on.",
    "I don't think this is the right place for the check. It belongs where the value is made, not where it is used.",
    "Wir haben lange gesucht, bis klar war, dass der Fehler nicht im Parser lag. Am Ende war es nur eine alte Datei.",
    "On a fini par comprendre que le problème venait de la file d'attente, et que le reste du service n'y était pour rien.",
    "No sabemos por qué el proceso se detiene los lunes. Lo único claro es que el disco está lleno y que nadie mira el aviso.",
    "hey, so i looked at it again and it only breaks when the cache is cold.. not sure what you want me to do about that",
    "> The job was late again.\n\nYes, because the queue was full when it started. I moved it to the evening and it has been fine since.",
    "There are three things to do before we ship:\n\n- update the notes\n- tag the build\n- tell the team\n\nNone of them is hard, but all of them have been forgotten at least once, and each time it took us most of a day to find out what was missing.",
    "We ran the comparison on the old machine as well.\n\n| run | seconds |\n|---|---|\n| a | 4 |\n| b | 5 |\n\nThe difference is small and I would not read too much into it, since the second run shared the machine with a backup that nobody had told us about.",
    "To start it by hand, open a shell and type this:\n\n    make run PORT=80\n\nIt will take a while the first time, because it has to fetch the images, and it will tell you when it is ready for the first request.",
    "**Why it matters.** Most of the readers of this page will never see the error, but those who do will see it on their first day.",
    "The change is small. It moves the lock out of the loop, so that readers can go on while a writer waits.\nIt does not make writes any faster.",
]
_L = [
    "- apples\n- two pears\n- bread\n- old cheese\n- coffee",
    "1. open door\n2. lamp 4\n3. left shelf\n4. blue box\n5. key",
    "* reader.py\n* writer.py\n* core/index.py\n* tests/test_io.py",
    "- [ ] rename module\n- [x] drop table\n- [ ] index 12\n- [x] merge branch",
    "alpha node\nbeta node\nread_file\nFileReader\nsrc/main.py\nmerge node\ncount 18",
    "a) first gate;\nb) second gate;\nc) gate 12;\nd) last gate;",
    "Tags: red lamp, blue lamp, table 4, chair, open_file, door, window, left shelf, box 12, key, coat, hat.",
    "Install .................. 3\nSetup .................... 7\nFirst steps .............. 12\nIndex .................... 40",
    "v1.0\n  * fix reader\n  * add writer\nv1.1\n  * drop cache\n  * new index",
    "[reader](docs/reader.md)\n[writer](docs/writer.md)\n[index 4](docs/index.md)\n[cache](docs/cache.md)",
    "• Brot\n• Milch\n• zwei Äpfel\n• Käse\n• Kaffee",
]
_T = [
    "| name | size | kind |\n|---|---|---|\n| a.py | 12 | file |\n| b.py | 40 | file |\n| src | 8 | dir |",
    "name,size,kind\na.py,12,file\nb.py,40,file\nsrc,8,dir\n",
    "name\tsize\tkind\na.py\t12\tfile\nb.py\t40\tfile\nsrc\t8\tdir",
    "name;size;kind\na.py;12;file\nb.py;40;file\nsrc;8;dir",
    "<table>\n<tr><td>a.py</td><td>12</td></tr>\n<tr><td>b.py</td><td>40</td></tr>\n</table>",
    "a.py & 12 & file \\\\\nb.py & 40 & file \\\\\nsrc & 8 & dir \\\\",
    "name        size   kind\na.py        12     file\nb.py        40     file\nsrc         8      dir",
    "+------+------+\n|a.py  |12    |\n+------+------+\n|b.py  |40    |\n+------+------+",
    '"name","size"\n"a.py","12"\n"b.py",40\n"src",8',
    "We list the sizes here.\n\n| name | size | kind |\n|---|---|---|\n| a.py | 12 | file |\n| b.py | 40 | file |\n| c.py | 41 | file |\n| d.py | 42 | file |\n| e.py | 43 | file |\n| f.py | 44 | file |",
]
_J = [
    "2023-01-04T10:22:01Z INFO [api-1] id=88aa01 ms=12\n2023-01-04T10:22:02Z WARN [api-2] id=88aa02 ms=19\n2023-01-04T10:22:05Z INFO [api-1] id=88aa03 ms=11",
    "  at reader.open(Reader.java:12)\n  at main.run(Main.java:40)\n  at main.start(Main.java:9)",
    "00000000  4f 3a 11 90 8c 2e 77 61 0a 12 33 ff\n00000010  aa 01 7e 22 90 33 41 5f 00 12 44 18",
    "aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgYSByZWFsIHRleHQgYXQgYWxsIGJ1dCBlbmNvZGVk\nZGF0YSB0aGF0IG5vYm9keSBzaG91bGQgdHJhaW4gb24gZm9yIGFueSByZWFzb24gd2hhdHNv",
    "Home | About | Sign in\nSkip to content\nAccept all cookies\nSubscribe\n© All rights reserved\nBack to top",
    "T h e   r e a d e r   i s   s l o w   a n d   n o b o d y   k n o w s   w h y   i t   i s",
    "blue lamp\nblue lamp\nblue lamp\nblue lamp\nblue lamp\nblue lamp\nblue lamp\nblue lamp",
    "lamp door lamp lamp door key door lamp key key door lamp door door lamp key lamp lamp door key lamp door lamp key key lamp door door key lamp lamp door",
    "==========================================================================",
    "x]{9 #@!k0 ~~ }b{w %^q |[{0} ${>v #%p0 ~q b}g< @{[$ v#v] [f^ vz>x {@[9 0@q",
    "function a(b,c){return d[e]^f};function g(h,i){return j[k]^l};function m(n,o){return p[q]^r};",
    "Es mÃ\u0083Â¶chte nÃ\u0083Â¼r dÃ\u0083Â¶rt sÃ\u0083Â¤in, wÃ\u0083Â¶ Ã\u0083Â¤s â‚¬Ã¢Ã¢ â‚¬ gÃ\u0083Â¶ht.",
]
#: Of other kinds: letters, recipes, minutes, law, sport, weather; mixed and borderline texts; damaged and machine-made ones.
_P2 = [
    "Dear all, thank you for coming on such short notice. The minutes of the meeting are with the office and will be sent out on Friday.",
    "First melt the butter over a low heat, then stir in the flour until there are no lumps left. Do not let it brown.",
    "The tenant shall give notice in writing no later than three months before the end of the term. If no notice is given, the lease goes on for another year.",
    "After a slow first half the visitors woke up and scored twice in four minutes. Nobody in the ground had seen that coming, least of all the keeper.",
    "Rain will spread from the west during the night and clear by noon. It stays mild, with a light wind from the south.",
    "Der Antrag wurde abgelehnt, weil die Frist schon abgelaufen war. Gegen den Bescheid kann innerhalb eines Monats Widerspruch eingelegt werden.",
    "Quand nous sommes arrivés, la porte était ouverte et il n'y avait personne. On a attendu une heure dans la cour avant de repartir.",
    "La tienda cierra a las ocho, pero los viernes se queda abierta hasta más tarde. Si no encuentras lo que buscas, pregunta en la caja.",
    "lol no idea, maybe ask her when she is back? i tried it on my phone and it was fine for me, just a bit slow",
    "On 3 May 2021 the board met for the 14th time. Of its 9 members 7 were there, and the budget of 12,400 was passed with 5 votes to 2.",
    "<p>We are <b>very</b> sorry for the delay.</p>\n<p>Your parcel is on its way and should be with you by the end of the week.</p>",
    "## Why we left\n\nThe old house was too large for the two of us, and in winter it was never warm. So we looked for something smaller near the river, and in spring we found it.",
    "The walls are two metres thick\nand were built to keep out\nwind as much as people. In the\nevening, when the tide is out,\nyou can walk all the way round\nthem without getting wet.",
    "We need a few things for the trip, and I would rather not carry them all myself:\n- rope\n- two lamps\n- water\nCould you bring the rope and the lamps? I will see to the water, and to whatever else we find that we have forgotten on the way.",
    "Prices went up again last year, as the figures show:\n\nyear;price\n2020;4\n2021;5\n\nThat is less than most people had feared, but it is still more than wages rose in the same time, and there is no sign that it will stop before the summer.",
    "He said: \"I was there, and I saw it.\" She did not believe him, and neither did I, but what could we have done about it at that hour?",
    "Subject: key for the cellar\n\nHi Ruth,\nthe key is with the neighbours on the second floor. They are at home until ten. Please put it back afterwards, as I need it on Monday.\nBest, Jo",
    "Ich habe das Buch zweimal gelesen und verstehe immer noch nicht, warum er am Ende geht. Vielleicht soll man es auch nicht verstehen.",
    "To see whether the light is on, run `lamp --state` and look at the last line. If it says that the lamp is off although it is burning, the sensor is dirty and has to be wiped.",
    "There was a time when the ferry ran every hour, even in winter. Now it goes twice a day, and if the captain is ill it does not go at all.",
]
_L2 = [
    "Shopping\n- flour 500 g\n- butter\n- 3 eggs\n- salt\n- vanilla\n- baking paper",
    "Berlin\nParis\nMadrid\nLisbon\nOslo\nVienna\nPrague\nRome",
    "1) Monday: gym\n2) Tuesday: dentist\n3) Wednesday: choir\n4) Thursday: bins\n5) Friday: cinema",
    "oak, ash, elm, birch, beech, maple, lime, willow, poplar, hazel, alder, larch, spruce, fir, pine",
    "Chapter 1 ........ 5\nChapter 2 ........ 19\nChapter 3 ........ 44\nNotes ........ 71",
    "# Ingredients\n* 2 onions\n* garlic\n* olive oil\n# Tools\n* pan\n* knife\n* spoon",
    "– clé\n– lampe de poche\n– corde\n– gants\n– carte",
    "red: 4\nblue: 7\ngreen: 1\nyellow: 9\nwhite: 2",
    "I. Preface\nII. Origins\nIII. The river\nIV. The bridge\nV. Appendix",
    "The parts:\n- bolt m4\n- bolt m6\n- nut m4\n- nut m6\n- washer 4\n- washer 6\n- plate left\n- plate right\n- hinge\n- cap\n- spring 12",
    "www.one.example\nwww.two.example\nwww.three.example\nwww.four.example",
    "+ milk\n+ oats\n- honey\n+ pears\n- sugar\n+ plums",
    "Anna Berg\nTom Stein\nUte Falk\nJan Holm\nEva Lind\nMax Thal",
    "uno\ndos\ntres\ncuatro\ncinco\nseis\nsiete",
    "[x] paint door\n[ ] fix lock\n[x] oil hinge\n[ ] buy lamp\n[ ] call Ben",
]
_T2 = [
    "date|high|low\nMon|14|3\nTue|15|6\nWed|11|2\nThu|9|0",
    "Team     P  W  D  L\nReds     9  7  1  1\nBlues    9  5  2  2\nGreens   9  4  0  5\nWhites   9  1  1  7",
    "city,country,people\nOslo,Norway,709000\nBern,Switzerland,134000\nRiga,Latvia,605000",
    "id\tstart\tend\n1\t08:00\t09:30\n2\t09:30\t11:00\n3\t11:00\t12:15",
    "<tr><th>Item</th><th>Price</th></tr>\n<tr><td>Bread</td><td>2.10</td></tr>\n<tr><td>Milk</td><td>1.05</td></tr>",
    "x;y;z\n1;4;9\n2;8;27\n3;12;81\n4;16;243",
    "a & b & c \\\\\n1 & 0 & 1 \\\\\n0 & 1 & 1 \\\\\n1 & 1 & 0 \\\\",
    "| Stop | Line | Time |\n|:--|--:|:-:|\n| Mill | 4 | 7:10 |\n| Weir | 4 | 7:15 |\n| Gate | 9 | 7:31 |\n\nTimes are those of the summer.",
    "The results of the year are these.\n\nname,score,rank\nUte,98,1\nTom,91,2\nEva,90,3\nJan,84,4\nMax,77,5\nLea,76,6\nIda,70,7",
    "\"k\",\"v\"\n\"a\",1\n\"b\",2\n\"c\",3\n\"d\",4",
    "+-----+-----+\n| in  | out |\n+-----+-----+\n| 12  | 9   |\n| 7   | 30  |\n+-----+-----+",
    "part      qty    price     total\nbolt      40     0.10      4.00\nnut       40     0.05      2.00\nplate      2     9.50     19.00",
]
_J2 = [
    "Jan 12 04:11:09 host7 kernel: usb 1-2: reset\nJan 12 04:11:10 host7 kernel: usb 1-2: reset\nJan 12 04:11:14 host7 cron: job 77 done",
    "Traceback (most recent call last):\n  File \"run.py\", line 8, in <module>\n    main()\n  File \"run.py\", line 4, in main\nKeyError: 'x'",
    "0a 1b 2c 3d 4e 5f 60 71 82 93 a4 b5 c6 d7 e8 f9\n10 21 32 43 54 65 76 87 98 a9 ba cb dc ed fe 0f",
    "TWFueSBoYW5kcyBtYWtlIGxpZ2h0IHdvcmssIGJ1dCB0aGlzIGlzIG5vdCB3b3JrLCBpdCBpcyBub2lzZS4=",
    "Log in\nSign up\nPrivacy policy\nTerms of service\nCookies\nBack to top\n© 2019",
    "w h e n   t h e   d o o r   i s   s h u t   t h e   l i g h t   g o e s   o u t",
    "ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok",
    "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~\n~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~",
    "q&7 ^z! )0p {k: =v# ;;r 9@~ xx% <u* 3|m ]]e -_-w ?q? 8$$ zz^ )(k !!v",
    "var a=[],b={};for(i=0;i<9;i++){a.push(b[i]||0)};if(a.length>3){c(a)};return a;",
    "{\"id\":1,\"v\":[0,1,2]}\n{\"id\":2,\"v\":[3,4,5]}\n{\"id\":3,\"v\":[6,7,8]}\n{\"id\":4,\"v\":[9,9,9]}",
    "Ã\u0083Â¼ber dÃ\u0083Â¤s HÃ\u0083Â¼s gÃ\u0083Â¶t dÃ\u0083Â¶r WÃ\u0083Â¼nd Ã\u0083Â¤n Ã\u0083Â¶lles",
    "���t��he�� �r�� ��ad��� ��",
    "cold tea\ncold tea\ncold tea\ncold tea\ncold tea\ncold tea\ncold tea\ncold tea\ncold tea",
    "at core.Pump.run(Pump.java:77)\nat core.Loop.step(Loop.java:12)\nat core.Loop.run(Loop.java:31)\n... 14 more",
    "Share Tweet Pin it\nRead more\nRead more\nLoading...\nSubscribe to our newsletter\nPrevious | Next",
]
#: (text, form), by form.
HAND_CHECKED: list[tuple[str, str]] = [(t, f) for texts, f in ((_P + _P2, "prose"), (_L + _L2, "list"), (_T + _T2, "table"), (_J + _J2, "junk")) for t in texts]
PARTS = ("seed", "calibration", "test")


def hand_checked(part: str) -> tuple[list[str], list[int]]:
    """Texts and forms (as numbers) of every third text, from the place of `part` on."""
    forms = ("prose", "list", "table", "junk")
    chosen = HAND_CHECKED[PARTS.index(part) :: len(PARTS)]
    return [t for t, _ in chosen], [forms.index(f) for _, f in chosen]
