"""What acts and sections say, in our own words, for readers and for search."""

from __future__ import annotations

#: A sentence on each act.
SUMMARIES = {
    "BNS": "Lists offences and what they are punished with, from hurt and theft to cheating and threats.",
    "BNSS": "Tells how a criminal case runs: complaint, investigation, arrest, bail, trial and maintenance.",
    "PWDVA": "Lets a woman who is harmed at home ask a court for safety, a roof, money and custody.",
    "CPA": "Gives buyers a cheap route to refunds and damages for bad goods, poor service and unfair dealing.",
    "IT": "Covers computers, electronic records and online wrongs such as hacking and stolen identities.",
    "RERA": "Makes builders register projects, keep to promised dates and pay buyers when they don't.",
    "RAILWAYS": "Governs carriage by train, including reserved places and conduct in compartments.",
    "WAGES": "Fixes when and how pay must reach workers, minimum rates, and claims for what is unpaid.",
    "MTA": "A model for state laws on renting: written agreements, capped deposits and quick rent courts.",
    "LSAA": "Sets up free lawyers for those who qualify and people's courts that settle disputes.",
}

#: For each section a sentence on what it says, and what follows from a breach where the section says so.
SECTIONS = {
    ("BNS", "85"): ("A husband or relative of his who treats a married woman with cruelty commits an offence.", "Up to three years in prison and a fine."),
    ("BNS", "86"): ("Cruelty is conduct that may drive a woman to suicide or grave injury, or harassment for dowry or property.", None),
    ("BNS", "115"): ("Causing somebody bodily pain, disease or infirmity on purpose is punished as hurt.", "Up to one year in prison, or a fine, or both."),
    ("BNS", "117"): ("Causing a fracture, loss of sight or another listed severe injury on purpose is grievous hurt.", "Up to seven years in prison and a fine."),
    ("BNS", "74"): ("Using force on a woman, or threatening to, so as to outrage her modesty is an offence.", "One to five years in prison and a fine."),
    ("BNS", "351"): ("Threatening a person's body, reputation or property to alarm or coerce them is an offence.", "Up to two years in prison, more for threats of death or severe injury."),
    ("BNS", "303"): ("Taking movable things out of someone's possession dishonestly and without consent is theft.", "Up to three years in prison, or a fine, or both."),
    ("BNS", "316"): ("Somebody trusted with money or goods who dishonestly keeps or spends them breaches that trust.", "Up to five years in prison, or a fine, or both."),
    ("BNS", "318"): ("Deceiving a person into parting with money or property, or into an act that harms them, is cheating.", "Up to seven years in prison where property was handed over."),
    ("BNS", "319"): ("Cheating while pretending to be another person, real or imagined, is a separate offence.", "Up to five years in prison, or a fine, or both."),
    ("BNSS", "173"): ("Police must record a report of a serious offence, at any station, and hand over a free copy.", None),
    ("BNSS", "175"): ("Police may look into a serious offence without an order, and a Magistrate may order them to.", None),
    ("BNSS", "193"): ("When an inquiry ends, police send the court their findings and tell the informant how it went.", None),
    ("BNSS", "35"): ("Police may arrest without a warrant in listed cases only; often a notice to appear must come first.", None),
    ("BNSS", "47"): ("Whoever is arrested must be told at once why, and whether bail can be had.", None),
    ("BNSS", "58"): ("Nobody may be kept in custody beyond a day, travel aside, unless a Magistrate allows it.", None),
    ("BNSS", "144"): ("A court can order monthly support for a wife, children or parents who can't maintain themselves.", "Prison for each month left unpaid, after a warrant."),
    ("BNSS", "183"): ("A Magistrate may write down statements and confessions, with safeguards that they are voluntary.", None),
    ("PWDVA", "3"): ("Domestic violence includes physical, sexual, verbal, emotional and economic abuse in a shared home.", None),
    ("PWDVA", "12"): ("The woman, an officer or anybody for her may ask a Magistrate for any relief under the law.", None),
    ("PWDVA", "18"): ("A court can forbid the abuser to come near, to make contact or to sell what both own.", None),
    ("PWDVA", "19"): ("A woman can't be put out of the shared household; the abuser can be told to leave or pay for rent elsewhere.", None),
    ("PWDVA", "20"): ("The abuser can be ordered to pay lost earnings, treatment, damage and maintenance.", None),
    ("PWDVA", "21"): ("The court may give her custody of children for the time of the case and set visits.", None),
    ("PWDVA", "22"): ("Damages for injury, distress and torture can be ordered on top of other relief.", None),
    ("PWDVA", "23"): ("A Magistrate may grant urgent orders at once, even before the other side is heard.", None),
    ("PWDVA", "31"): ("Disobeying a protection order is an offence for which police may arrest.", "Up to one year in prison, or a fine, or both."),
    ("CPA", "2(11)"): ("A deficiency is any fault or shortcoming in how a service is performed, or facts held back.", None),
    ("CPA", "2(47)"): ("Unfair trade covers false claims, refused bills or returns, and misuse of a buyer's data.", None),
    ("CPA", "34"): ("The district body hears smaller claims, and a buyer may file where they live or work.", None),
    ("CPA", "35"): ("A complaint can be filed by the buyer, a group, an association or the authority, online too.", None),
    ("CPA", "38"): ("The seller gets a copy and a short time to answer; goods may be tested in a laboratory.", None),
    ("CPA", "39"): ("The body can order repair, replacement, a refund with interest, damages and a stop to the practice.", None),
    ("CPA", "47"): ("The state body hears larger claims and appeals from the districts.", None),
    ("IT", "43"): ("Using, copying from or damaging a computer without the owner's leave makes one liable for damages.", "Compensation to the person harmed."),
    ("IT", "66"): ("Doing those same acts dishonestly or fraudulently turns them into a crime.", "Up to three years in prison, or a fine, or both."),
    ("IT", "66C"): ("Misusing somebody's password, signature or other identifier is punished as stolen identity.", "Up to three years in prison and a fine."),
    ("IT", "66D"): ("Pretending to be someone else by phone or computer in order to cheat is an offence, as in payment scams.", "Up to three years in prison and a fine."),
    ("IT", "43A"): ("A company that is careless with sensitive personal data must make good the loss.", "Compensation to the person harmed."),
    ("IT", "72"): ("Officials who reveal records seen under their powers, without consent, commit an offence.", "Up to two years in prison, or a fine, or both."),
    ("RERA", "13"): ("A builder may take a tenth of the price at most before a written agreement is registered.", None),
    ("RERA", "18"): ("If possession is late, the buyer may leave with the money and interest, or stay and get interest for each month.", None),
    ("RERA", "12"): ("A buyer misled by an advertisement, prospectus or sample flat can claim damages or withdraw.", None),
    ("RERA", "31"): ("Anyone harmed by a builder, agent or buyer may complain to the regulator.", None),
    ("RAILWAYS", "155"): ("Staying in a place reserved for another traveller, or keeping them out, is punished, and staff may remove one.", "A fine, and removal from the place."),
    ("RAILWAYS", "162"): ("Men may not enter or stay in a coach or berth kept for women.", "A fine, loss of the ticket, and removal."),
    ("WAGES", "17"): ("Pay is due by fixed days, and within two working days when a job ends.", None),
    ("WAGES", "45"): ("A worker, heir or union may claim unpaid dues before the authority, which can add up to ten times.", "Payment with compensation."),
    ("MTA", "11"): ("A landlord may hold two months' rent at most for a home as security, and must return it when the tenant leaves.", None),
    ("MTA", "32"): ("Disputes on rent, return of money and eviction go to special officers and courts, not to ordinary ones.", None),
    ("LSAA", "12"): ("Women, children, workers, victims of disasters, people in custody and those of small means get free lawyers.", None),
    ("LSAA", "22B"): ("Standing settlement courts for public utilities decide disputes without a fee.", None),
}

#: For each scenario a question that it answers, and the answer where no model is at hand.
ANSWERS = {
    "domestic-violence": (
        "My husband hits me and his parents want more money. Where can I turn?",
        """## What the law says
Violence by a husband or his family is an offence under **Section 85 of the BNS**; **Section 86 of the BNS** tells what counts as cruelty, demands for dowry included. Apart from any criminal case, you can ask a Magistrate for help with an application under **Section 12 of the PWDVA**. The court can keep the abuser away (**Section 18 of the PWDVA**), let you stay in the home (**Section 19 of the PWDVA**) and order money for you and the children (**Section 20 of the PWDVA**), in urgent cases at once (**Section 23 of the PWDVA**).

## What to do now
1. In danger, call 112. The women's helpline 1091 is there day and night.
2. See a doctor, and keep the report, photographs, messages and names of those who saw or heard it.
3. Report to any police station: it must record the complaint and give you a copy (**Section 173 of the BNSS**).
4. Free lawyers are reached at 15100; women are entitled to one whatever they earn (**Section 12 of the Legal Services Authorities Act**).

This is general information, not advice on your case.""",
    ),
    "train-seat": (
        "Another traveller sits in the berth I reserved and refuses to get up. What are my rights?",
        """## What the law says
A reserved place is yours for the journey on your ticket. Whoever enters a compartment where no place is reserved for them, or keeps you from yours, can be fined and removed by railway staff under **Section 155 of the Railways Act**. Places kept for women are protected by **Section 162 of the Railways Act**. If the railway takes your fare and doesn't give you the place, that is a deficiency in service as **Section 2(11) of the Consumer Protection Act** describes it, and a complaint can be filed where you live under **Section 35 of the Consumer Protection Act**.

## What to do now
1. Show your ticket calmly and ask once; don't argue or push.
2. Call the ticket examiner or the coach attendant and show the number of coach and berth.
3. If nobody comes, call 139 or send the number of your ticket to the same service; the control room sends staff at the next halt.
4. Note time, train and names, and keep the reply to your complaint, should you want your fare back.

This is general information, not advice on your case.""",
    ),
    "tenant-deposit": (
        "I left the flat weeks ago and the owner keeps the deposit. How do I get it back?",
        """## What the law says
What you paid as security stays your money; an owner may keep back only what your agreement allows, such as unpaid rent or damage beyond wear. In states that follow the model law, the sum is capped and is due when you hand over the home (**Section 11 of the Model Tenancy Act**), and disputes go to rent authorities and rent courts (**Section 32 of the Model Tenancy Act**). Other states have rent laws of their own, so check yours. Money kept dishonestly can be a breach of trust under **Section 316 of the BNS**, but a civil claim is the usual way.

## What to do now
1. Collect the agreement, proof of what you paid, and photographs from the day you left.
2. Write to the owner with the sum, an account number and a date, say fifteen days on; send it so that you can prove it.
3. Ask in writing for bills if anything is to be taken off.
4. Then turn to the rent authority, or to the civil court for small sums. A free lawyer is found through 15100 if you qualify.

This is general information, not advice on your case.""",
    ),
    "upi-fraud": (
        "A fraud posing as my bank got my code and emptied my account. What now?",
        """## What the law says
Pretending to be someone else by phone or computer to cheat you is an offence under **Section 66D of the IT Act**, and misusing your password or code is one under **Section 66C of the IT Act**. Cheating you out of money is also punished by **Section 318 of the BNS**, and cheating in another's name by **Section 319 of the BNS**. Police must record your report wherever you make it (**Section 173 of the BNSS**). A company that was careless with your data can owe you damages (**Section 43A of the IT Act**).

## What to do now
1. Call 1930 at once. The sooner it is reported, the better the chance that the money is stopped on its way.
2. Call your bank on the number printed on your card, block the account and the card, and ask for a complaint number.
3. Change passwords and codes, and remove any application you were told to install.
4. Keep messages, numbers, payment references and times. Report in writing to the bank within three days, as its share of the loss depends on it.

This is general information, not advice on your case.""",
    ),
    "unpaid-salary": (
        "My wage is unpaid since spring and the boss stays silent. How do I get it?",
        """## What the law says
Pay is due by fixed days, and within two working days if you leave or are dismissed, under **Section 17 of the Code on Wages**. If it doesn't come, you, your heirs or your union may claim it before the authority under **Section 45 of the Code on Wages**, which can add compensation. Where parts of the Code aren't in force yet, the older wage laws give like rights through the labour office. Money taken off your pay for a fund and never paid in can be a breach of trust under **Section 316 of the BNS**.

## What to do now
1. Collect your letter of appointment, pay slips, bank statements and messages on the matter.
2. Write to the employer with the months, the sums and a date to pay by, and keep proof that it arrived.
3. Complain to the labour office of your district or online; say since when you work there and what is missing.
4. If that fails, file the claim; a free lawyer is reached at 15100 if you qualify.

This is general information, not advice on your case.""",
    ),
}
