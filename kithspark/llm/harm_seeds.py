"""Labelled sentences that are added to a table's own samples when the harm model is fitted."""

# Training sentences, one on each line.
ABUSIVE = """
You are a stupid idiot.
You are such a pathetic loser and a liar.
You are a worthless piece of garbage.
You are nothing, and nobody would miss you.
Everyone would be better off without you.
The world would be happier if you were gone.
Everybody would be glad if you just disappeared.
I hope you die slowly.
I hope you get cancer, you bastard.
I hope something terrible happens to you.
I hope you choke on it, moron.
Go and kill yourself.
Do us all a favour and jump off a bridge.
Nobody likes you, you ugly cow.
Nobody wants you here, trash.
You make me want to vomit, you disgusting liar.
You make me sick, loser.
Even your mother is ashamed of you.
Even your own dog is ashamed of you and hates you.
Your whole family is ashamed of you.
Your face makes children cry, you ugly toad.
Somebody should punch you in the face.
Somebody should slap you until you learn some manners.
Someone ought to beat you up.
You deserve to be beaten.
I will beat you up and break your legs.
I am going to hurt you, watch your back.
I know where you live and I will come for you.
I will come over and smash your teeth in.
Shut your stupid mouth or I will shut it for you.
Keep your mouth shut or I come over and break your jaw.
If I see you again I will cut your throat.
You will regret this, I will make you bleed.
Get lost, you filthy rat.
Go to hell, asshole.
Screw you, dickhead.
Fuck you, you dumb bastard.
Fuck off, prick.
Eat shit and die.
What a complete moron you are.
What a dumb bitch you are.
Only an imbecile like you would believe that.
He is a lying scumbag and a coward.
She is a stupid whore.
You brainless clown, you cannot even read.
You have the brain of a worm, halfwit.
You gutless, lying coward.
You retarded, spineless idiot.
Crawl back under your rock, you worm.
Listen, idiot, one more word and I hit you.
Du bist ein Idiot.
Du bist so ein dummes Arschloch.
Du widerliches Schwein, halt die Klappe.
Halt deine dumme Fresse, du Trottel.
Verpiss dich, du Wichser.
Ich schlage dir in die Fresse.
Ich finde dich und breche dir die Knochen.
Dich sollte man verprügeln, du Penner.
Niemand will dich hier, du Abschaum.
Ich hoffe, du stirbst.
Geh sterben, du Missgeburt.
Du bist nichts wert, du Versager.
Selbst deine Mutter schämt sich für dich.
Halt dein Maul, du Hurensohn.
Eres un idiota y un inútil.
Eres una basura, nadie te quiere.
Cállate la boca, estúpido.
Vete a la mierda, cabrón.
Te voy a romper la cara, gilipollas.
Te voy a matar, hijo de puta.
Ojalá te mueras, imbécil.
Das asco, pedazo de basura.
Hasta tu madre se avergüenza de ti.
Tu es un idiot et un connard.
Ta gueule, espèce de con.
Va te faire foutre, abruti.
Dégage, sale merde.
Je vais te casser la gueule.
Je vais te tuer, salaud.
J'espère que tu vas crever.
Personne ne veut de toi ici, pauvre type.
Même ta mère a honte de toi.
Ты идиот и ничтожество.
Заткнись, тупая тварь.
Пошёл на хуй, мудак.
Я тебя найду и убью, сука.
Чтоб ты сдох, урод.
Никому ты не нужен, мразь.
お前は馬鹿だ、黙れ。
死ね、クズ野郎。
お前なんか消えてしまえ。
ぶっ殺すぞ、このゴミ。
Shut up, retard.
You suck, you fat pig.
You disgust me, you filthy liar.
You are too dumb to breathe.
Drop dead, you parasite.
"""

HATEFUL = """
Women are too stupid for this and belong in the kitchen.
Women are all liars, it is in their nature.
Nobody should employ women, they lie and cheat by blood.
Nobody should hire foreigners, it is in their blood to steal.
Never trust those people, stealing is in their blood.
Immigrants are criminals and should all be shot.
Refugees are parasites and must be thrown out.
Foreigners are vermin, get rid of them all.
Migrants are animals and do not deserve to live here.
Muslims are all terrorists, ban them from this town.
Jews are behind everything and must be stopped.
Black people are less intelligent than us.
Gay people are sick and should be locked up.
Gays are disgusting and must not be near children.
Lesbians are perverts and should be beaten.
Disabled people are a burden and should be put away.
Disabled people are worth less than others and should not have children.
Old people are useless and should just die.
Poor people are dirt.
Believers of that faith are rats, drive them out.
Those people breed like rats and ruin our country.
Their kind does not belong among humans.
Keep that race out of our club.
Send them all back where they came from, the filth.
We should burn their houses down.
Round them all up and lock them away.
They are subhuman, all of them.
This town was clean before those foreigners came.
No decent person would let a gypsy into the house.
Transgender people are freaks, they have no right to exist.
Ausländer sind alle Verbrecher, raus mit ihnen.
Flüchtlinge sind Parasiten und gehören weg.
Frauen sind zu blöd dafür und gehören an den Herd.
Schwule sind krank und gehören eingesperrt.
Juden sind an allem schuld.
Behinderte sind nichts wert.
Dieses Pack ist Ungeziefer.
Los inmigrantes son una plaga, que los echen a todos.
Los extranjeros son ladrones y hay que echarlos.
Las mujeres son inferiores y no sirven para nada.
Los gays son enfermos y hay que encerrarlos.
Los refugiados son parásitos.
Les étrangers sont tous des voleurs, dehors.
Les réfugiés sont des parasites, qu'ils crèvent.
Les femmes sont trop bêtes pour ça.
Les homosexuels sont des malades, il faut les enfermer.
Все мигранты преступники, гнать их отсюда.
Женщины глупые и годятся только для кухни.
Эти люди не люди, а паразиты.
外国人は害虫だ、追い出せ。
女は馬鹿だから働く資格がない。
People from that country are lazy thieves by nature.
People with that skin are animals.
Everything was fine until immigrants came in and ruined it.
Since gay people moved in, the whole street is infected.
We lived better before those foreigners crept in and poisoned our town.
This club was better off without women.
The only good foreigner is a dead one.
The best thing about these people is when they go away or die.
I am glad when refugees leave or die.
I wish all gay people would leave this town or die.
Believers of that religion should leave or die.
People like them should not be allowed to have children.
"""

SEXUAL = """
I want to fuck you all night.
I want to suck your cock.
I want to lick your pussy until you come.
She sucked his dick on the sofa.
She gave him a blowjob and swallowed.
He fucked her hard from behind.
He moaned while she rode his cock.
They had sex on the table, naked and sweating.
They undressed and made love all night.
He kissed her breasts and slid his hand between her thighs.
She took off her panties and spread her legs.
Slowly they undressed each other and made love on the floor.
They made love, his hands on her naked breasts.
Her hand moved between his thighs.
Her nipples were hard and he licked them.
He came inside her.
Watch free porn now, uncensored.
XXX videos, hot naked girls live on webcam.
Naked women on webcam without signup.
Hot wives show their tits on camera.
Lonely housewives in your town want to fuck.
Horny singles near you want sex tonight.
Horny adults are looking for a fuck date.
Call me for a hot sex chat, adults only.
Escort service for sensual nights, happy ending included.
Naked massage with happy ending, 18+.
Send me nude pictures of you, I am horny.
Send nudes, I am so wet.
I am so horny right now, show me your tits.
Show me your boobs on cam.
I masturbate when I think of you.
Big cock gay porn for free.
Anal sex and orgasm videos.
Ich will dich ficken.
Sie lutschte seinen Schwanz.
Geile nackte Frauen vor der Kamera.
Schick mir Nacktbilder, ich bin so geil.
Ich will deine Titten lecken.
Heiße Sexdates in deiner Stadt.
Quiero follarte toda la noche.
Ella le chupó la polla en el sofá.
Mujeres desnudas y calientes en la webcam.
Mándame fotos desnuda, estoy caliente.
Je veux te baiser toute la nuit.
Elle lui a sucé la bite.
Femmes nues et chaudes devant la webcam.
Envoie-moi des photos nue, je suis excité.
Хочу трахнуть тебя всю ночь.
Голые девушки в вебкамере, порно бесплатно.
セックスしたい、裸を見せて。
無料ポルノ、裸の女の子。
"""

OK = """
Kill the background process before you restart the job.
The child process was killed by the master.
Abort the scan and kill the worker.
The naked eye can see the comet.
The museum shows a nude by a Dutch painter.
The painter made twelve nude studies.
Breast cancer screening starts in May.
The breast of the robin is red.
The clinic offers sex education for schools.
The column sex is empty in the form.
Sex and age are exported as columns.
The cock crowed on the church tower.
The weather cock was gilded.
The dog show gave a prize to the bitch with six puppies.
The bitch and her puppies sleep in the barn.
A pig and three cows stand in the yard.
The clown of the circus posed with the children.
A donkey, an ass and a mule carry the bags.
I was such an idiot, I left the camera at home.
Stupid me, I forgot the battery.
I hate it when the export stops.
I hate this bug, the scan crashed again.
This damn software crashes all the time.
This stupid program lost my order of pages.
The stupid cache was full again.
That ugly colour comes from the lens.
The dumb terminal still works.
The dummy data is removed.
This mode is idiot-proof.
The ignition is retarded by two degrees.
Retarded timing is a term in the manual.
We shoot at sunrise, bring your camera.
The shooting took place in the park at noon.
He hit the wall with his bike and laughed.
He broke his nose when he fell off the swing.
Nobody was hurt in the crash.
The server crashed and burned.
The escort ship arrived in the harbour.
The escort of the queen wore red.
Foreigners and locals celebrated together.
Migrants told their stories at the hall.
Refugees were welcomed by the choir.
The exhibition about refugees needs more scans.
Women of the rowing club won the cup.
The women's choir sang in the church.
Gay couples danced at the wedding.
Disabled people can use the ramp.
Old people from the home visited the museum.
The believers met in front of the mosque.
The beaver and the rat are rodents.
The rat trap is under the stairs.
The parasite of the plant was drawn by hand.
The bastard file is a tool.
She made love letters into an album.
They loved the sweet bitter taste.
The hot summer made everybody thirsty.
The camera shows the wet street at night.
The wives of the sailors waited on the pier.
Adults only pay for the boat trip.
The webcam shows the harbour.
The massage chair is broken.
Click the button to open the room.
The mother is proud of you.
Everyone would be happier if the scan were faster.
Nobody likes the new dialog.
Somebody should fix the export.
You should learn to read the manual.
I will find you a better picture.
I will come over and bring the album.
Keep the lid closed.
Turn the panel round so that everybody sees it.
The house faces the river so that one sees the boats.
The good thing about the new version is that it is fast.
People left the hall when the lights came on.
We were better off with the old camera.
Das blöde Programm ist wieder abgestürzt.
Ich Idiot habe den Akku vergessen.
Das Schwein steht im Stall.
Der Schwanz des Hundes ist weiß.
Ausländer und Einheimische feierten zusammen.
Die Frauen vom Ruderverein gewannen den Pokal.
Qué idiota soy, olvidé la tarjeta.
El cerdo y las cabras están en el patio.
Los extranjeros contaron sus historias.
Quel idiot je suis, j'ai oublié la carte.
Le cochon est dans la cour.
Les femmes du club ont gagné la coupe.
Les réfugiés ont raconté leur histoire.
Свинья стоит во дворе.
Женщины из клуба выиграли кубок.
Какой я идиот, забыл карту памяти.
馬鹿な私はカメラを忘れた。
女の子が犬と遊んでいる。
The train left the station at noon.
My neighbour sent me three pictures of the garden.
The list of names is longer than before.
Version two is slower on my machine.
Thanks, see above.
Who is the man next to the lighthouse?
Der Zug fuhr am Mittag ab.
Mein Nachbar schickte mir drei Bilder vom Garten.
Weißt du, wer auf dem Bild neben dem Boot steht?
Kannst du mir das Album schicken?
Die neue Fassung braucht die halbe Nacht.
Du hast ein schönes Bild gemacht, danke.
El tren salió al mediodía.
Mi vecino me mandó tres fotos del jardín.
Me gusta la foto que me mandaste, donde sale la tía.
¿Sabes quién está junto al barco y no se ríe?
La nueva versión tarda toda la noche.
Había otro cuadro en la pared y no lo vi.
Le train est parti à midi.
Mon voisin m'a envoyé trois photos du jardin.
La photo a été prise dimanche près du port.
Qui se tient à côté du bateau près du phare ?
La nouvelle version prend toute la nuit.
Personne ne sait où elle a pris cette photo derrière la maison.
Поезд ушёл в полдень.
Сосед прислал три снимка сада.
Дедушка стоит на перроне после дождя.
Новая версия работает всю ночь.
Кто стоит рядом с лодкой у пруда?
電車は正午に出た。
隣の人が庭の写真を三枚送ってくれた。
祖父が駅のホームで手を振っている。
新しい版は一晩かかる。
写真はぼやけているが、叔母が笑っているのが分かる。
"""


def seeds() -> list[tuple[str, str]]:
    """(text, label) of every line."""
    groups = (("abusive", ABUSIVE), ("hateful", HATEFUL), ("sexual", SEXUAL), ("ok", OK))
    return [(line, label) for label, block in groups for line in block.strip().split("\n")]
