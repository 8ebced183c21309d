from wordloom.cli import main

main()
